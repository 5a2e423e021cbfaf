"""Word lists of the text operators."""

#: Common English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself
they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't
wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)
#: Page furniture that is no topic.
BOILERPLATE = frozenset(
    "email digest homepage feed newsletter subscribe subscription menu navigation sidebar footer header cookie privacy policy terms service copyright reserved rights contact facebook twitter instagram linkedin youtube social share comment comments reply login signup register search advertisement sponsored promo promotion".split()
)
#: Words too general to be a topic's technical term.
GENERIC_TERMS = frozenset("system technology company data research service platform solution business market industry product customer management global world new report news today year".split())
#: Nouns too general to be keywords.
GENERIC_NOUNS = frozenset("business company market economy government state people industry".split())
#: Two-letter words that are also tickers.
SHORT_WORDS = frozenset("am an as at be by do go he hi if in is it me my no of on or so to up us we".split())
#: Three-letter and longer words that are also tickers.
COMMON_WORDS = frozenset(
    "all and are but can car cat day did dog eat far few for fun get got had has her him his how its let man may new not now old one our out own put ran red run said saw say see set she sit six ten the too top two use was way who why win yes yet you app box data file key link live main net open post real site tech text true type uber user web work zoom".split()
)
#: Names of funds contain one of these.
FUND_MARKS = ("etf", "exchange traded fund", "exchange-traded fund", "mutual fund", "index fund")
SUFFIXES = r"\b(inc\.?|corp\.?|corporation|company|ltd\.?|limited|llc|plc)\b"
#: Stop words of company key phrases.
PHRASE_STOPS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by could did do does doing down during each few for from further had has
have having he her here hers herself him himself his how i if in into is it its itself let me more most my myself no nor not of off on once only or other ought our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves""".split()
)
#: Key phrases that go when they are just one of these.
PHRASE_EXACT = (
    "united states", "north america", "south america", "europe", "asia pacific", "middle east", "latin america", "formerly known", "headquartered", "based in",
    "founded in", "inc .", "llc .", "plc .", "company inc", "corporation inc", "including ads", "include cloud", "including enterprise", "amazon web services",
    "azure quantum", "amazon braket",
)
#: Key phrases that go when they contain one of these; then those that start or end so.
PHRASE_PARTS = (
    "beverage", "formerly known", "headquartered", "based in", "founded in", "inc .", "llc .", "plc .", "middle east", "latin america", "segment provides",
    "segment focuses", "segment engages", "segment includes", "segment develops", "amazon web services", "amazon braket", "azure quantum", "beverage group holdings",
)
PHRASE_FIRST = ("also", "provides", "offers", "includes", "company", "various", "such", "primarily", "facilitates")
PHRASE_LAST = ("company", "inc", "corporation", "segment", "segments", "across", "related", "worldwide")
#: Phrases that hold one of these always stay among a topic's terms.
DOMAIN_MARKS = ("quantum", "semiconductor", "crypto", "cryptography")
