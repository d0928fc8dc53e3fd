"""telar: bitext synthesis and corpus analytics as lazy Spark plans."""
