"""Words that say nothing of a gloss's frequency, English and Spanish, by length."""

STOPWORDS = tuple((
    "a e i o u y al an as at be by de do el en es go ha he if in is it la le lo me mi my no of on or os se si so su te to tu tú un us we yo él all and any "
    "are but can con del did era esa ese for fue get got had han has her him his its las les los may mis muy más nos one our por que ser she sin son soy "
    "sus tan the too tus una was you algo ante bajo been cada como cosa does done each ella eran eres esas esos esta este está from gone hace hago have "
    "hers hizo into just less mine more most must ones only onto otra otro ours over para pero poco sido some than that them they this toda todo tras unas "
    "unos upon very went were when will with your about aquel being could desde doing donde ellas ellos entre estar estas estos estoy están estás every "
    "gente going haber había hacer hacia hasta hecho hemos least menos might mucha mucho otras otros quite sobre somos tanto tener tengo tenía their these "
    "thing those tiene todas todos under usted while would yours anyone contra cuando estaba estado fueron gotten habido habían having itself muchas muchos "
    "myself person porque should siendo tenido theirs tienen alguien anybody aquella because estaban estamos estando getting herself himself nuestra "
    "nuestro persona someone through ustedes vuestra vuestro without anything aquellas aquellos haciendo hicieron nosotras nosotros nuestras nuestros "
    "somebody yourself ourselves something themselves "
).split())
