"""The default English stop list."""

from __future__ import annotations

# All words of the list, in alphabetical order. The odd spellings are intended.
STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along already also
    although always am among amongst amoungst amount an and another any anyhow anyone
    anything anyway anywhere are arent around as at back be became because become becomes
    becoming been before beforehand behind being below beside besides between beyond bill
    both bottom but by call can cannot cant co con could couldnt cry de describe detail did
    didnt do does doesnt doing done dont down due during each eg eight either eleven else
    elsewhere empty enough etc even ever every everyone everything everywhere except few
    fifteen fify fill find fire first five for former formerly forty found four from front
    full further get give go had hadnt has hasnt have havent having he hed hell hence her
    here hereafter hereby herein heres hereupon hers herself hes him himself his how however
    hows hundred i id ie if ill im in inc indeed interest into is isnt it its itself ive
    keep last latter latterly least less lets ltd made many may me meanwhile might mill mine
    more moreover most mostly move much must mustnt my myself name namely neither never
    nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on
    once one only onto or other others otherwise ought our ours ourselves out over own part
    per perhaps please put rather re same see seem seemed seeming seems serious several
    shant she shed shell shes should shouldnt show side since sincere six sixty so some
    somehow someone something sometime sometimes somewhere still such system take ten than
    that thats the their theirs them themselves then thence there thereafter thereby
    therefore therein theres thereupon these they theyd theyll theyre theyve thickv thin
    third this those though three through throughout thru thus to together too top toward
    towards twelve twenty two un under until up upon us very via was wasnt we wed well were
    werent weve what whatever whats when whence whenever whens where whereafter whereas
    whereby wherein wheres whereupon wherever whether which while whither who whoever whole
    whom whos whose why whys will with within without wont would wouldnt yet you youd youll
    your youre yours yourself yourselves youve
    """.split()
)


def english_stop_words() -> tuple[str, ...]:
    """The default stop words, sorted."""
    return STOP_WORDS
