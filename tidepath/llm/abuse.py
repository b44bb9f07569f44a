"""Abusive, hateful or sexual content: a lexicon trie met by Levenshtein automata, and context windows.

Method. The visible text is unfolded (compatibility forms, invisible characters, look-alike letters, digits for
letters, masked and spaced-out letters). Each distinct word runs as a Levenshtein automaton over a trie of all
words of the lexicon, which gives the lexicon's words within a distance that grows with length. Hits become
scores by their context window: a term counts in full when aimed at a person (second person, a name, "such a",
"what kind of"), and not when aimed at oneself or a thing, or when the window speaks about such words. Phrases of
the lexicon (three words at most) score as a whole, with at most one word between two of theirs. Patterns of word sets (who means which
harm to whom, which group is called what) find wordings that no phrase holds.

Scale. Messages are scored where they are read, batch by batch; nothing is shuffled. The automata's answers are
kept for the words of a batch only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.llm.mail import visible
from tidepath.sources.tables import spread

# Word lists of our own, by kind.
PERSON = """idiot idiots imbecile imbeciles moron morons cretin cretins halfwit halfwits bastard bastards dickhead dickheads
asshole assholes arsehole prick pricks scumbag scumbags parasite parasites lowlife lowlifes loser losers clown retard retards pig cow
bitch cunt whore slut twat turd scum jerk dumbass dimwit nitwit coward filth wanker dipshit shithead motherfucker bimbo rat vermin
vollidiot arschloch wichser schlampe hurensohn drecksau missgeburt spatzenhirn trottel dummkopf schwachkopf
connard connasse salopard salope abruti crétin imbécile ordure enculé
gilipollas cabrón imbécil pendejo inútil estúpido hijoputa zorra""".split()
SLUR = """stupid worthless spineless snivelling sniveling pathetic useless miserable disgusting filthy ugly lying goddamn braindead fat
fucking brainless dumb sale espèce pedazo dummes""".split()
# short wordings of three words at most; whatever is longer is left to the patterns
HATE = "subhuman|subhumans|ungeziefer|untermenschen|abschaum|let rats run|well let rats|knew to kneel".split("|")
THREAT = """won't walk again|you'll bleed|watch your back|kill yourself|kys|break your legs|you will regret|hope you die|you should die|go to hell|fuck yourself|fuck you|fuck off|shut your mouth|shut up you|kiss my ass
verpiss dich|fick dich|halt dein maul|die zähne ein|verrecke|stirb endlich|müll raustragen|ferme ta gueule|va te faire|crève donc|cierra la boca|vete al infierno|no vuelvas nunca|muérete
stfu|gtfo|nobody asked|piece of shit|waste of space|waste of oxygen|waste of skin|take your shit""".replace("\n", "|").split("|")
SEXUAL = """legs apart|your tits|tits|your pussy|blowjob|blowjobs|my dick|makes you wet|until you scream|his cock|rode him|while he moaned|her nipples|nipples between|horny singles|xxx clips|uncensored|hardcore sex|porn|wet girls|live cams|naked wives
nude pics|send nudes|between her thighs|follarte|sin bragas|te baiser|sans culotte|dich ficken|ohne höschen|ficken|suck my|cum on|your breasts|your blouse|blouse""".replace("\n", "|").split("|")
HAN = "你去死 去死吧 去死 混蛋 滚出去 滚开 害虫 废物 傻逼 傻瓜你 蠢货 贱人 婊子 全部赶走 做爱 脱光 裸照 没人会想你 死ね 殺す クズ 馬鹿野郎 害虫だ 追い出せ 裸の写真 やりたい 間抜け 消えろ お前みたいな ぶっ殺 くたばれ セックス".split()
# words within reach of a lexicon word that are no misspelling of it
PLAIN = """regards regard regarded reward rewards retain retained studio clowns cows pigs rats lose loses closer looser poser laser bastion batch pitch ditch witch hitch bits ditches switch stitch match bench beach porn0 born corn port part pork pore post picks pricing price priced prices brick trick bricks tricks
cretan cretans cretinous moors motion mormon moro lying flying plying dying tying buying paying saying laying fat far fax fit cat hat rate rates late sale sales scale salt dump thumb numb crumb uglier used user useful uses unless usable reuse
filters filtered filter parade paradise moron's idiom idioms jerk clerk turn turns tits bits hits sits its tips ticks coward towards toward count counts hunt cant can't couldn't blouse house mouse hose horse horses homely where whole wholly shore whose
lighter fighter lists list trots total rotor slot slut's shut cut scam slum plum species espace bales shame shake bake pedal saline seal seals females disease deceased cages pages wages stages vermillion
gly ling vying ying sucking dub dum umb ale bale dale gale hale kale male pale safe sage sake salem salv same sane save shale sle sole stale tale vale yale coron moon moran morton moroc morons' pick ric rick
lover lovers lower lowers lasers blown crown flown grown brown birch itch mitch aunt cent cont count cult curt cust punt unt chore chose wore clut glut slit slug slur sur swat tat that wat what burd hurd kurd murd tud tur turb turf turk third tire
berk jere perk howard fifth banker bankers tanker tankers walker walkers wander wanders limbo termin termine slope slopes korra mormons desk jury discussing athletic
girl ender sunder liar lars dairy daisy dives gives lives waves wines wipes wires steal stead steak steam steel ballet wont horn horns bloom brood flood blond beasts earn lean learns month moth south youth houth awhile chile whale whine white niece pieces pierce apiece heading leading readings couch pouch torch tough
county country property properly earth berth births doing ging cafes cage cakes cares cases caves cards sierra flour flood floors until whenever sting stint stick sink stink paces spaces spaced spare spate spice buffer buffers suffers chaise chaque classe chasse baked faked named word words worlds bought fought sought cream stream bikes hikes lakes lies lines linked liked lives dont donc
caster passer casser known knots cents debts dens rents tents vents catch hatch latch patch kaiser shirt shoot short sort sport shorts singers caste haste paste taste tasty tested wasted noting threads threat threats highs gain shouldn cheek chick chuck heck regrets partie partir skirt chips clip eclipse flips lips slips dense tense senses sende sensed blend breed major memory chap cheat heap hours ours tours cours house rouse houses bleak bread breaks breaking freak mature
tighter nicer worse insider dudes nodes notes cold could gould mould spart hapart aparte maker makers males mates takes wakes knee knees would wound longs along masked tasked press drive driver drives driven plague plaza bands sands lands hangs clams crying animate pace shout shot chase tread util moons disrupting improperly scram denis""".split()

# patterns over the words of a message (English), made of small sets: who, which harm, which part, which predicate
_MEAN = r"(?:i'll|i will|i'm going to|i am going to|i'm gonna|i am gonna|gonna|we'll|we will|we're going to|i want to|i'd love to|i swear i'll|some(?:one|body) (?:should|ought to|needs to|has to))"
_LIMB = r"(?:face|skull|head|jaw|teeth|throat|neck|legs?|arms?|bones|fingers|knees?|kneecaps|ribs|nose|tongue|guts|eyes|house|grin|smile)"
_BODY = r"(?:breasts?|tits|boobs|nipples?|thighs?|pussy|cock|dick|ass|arse|butt|clit|crotch|body|cunt|panties|bra|knickers)"
_WHO = r"(?:(?:those|these|you|such) (?:[\w'-]+ )?people|(?:your|their|that) (?:kind|sort|lot)|(?:those |these |all |the )?(?:im)?migrants|foreigners|refugees|(?:all |those |the )?(?:women|jews|muslims|christians|blacks|gays|lesbians|gypsies|arabs|asians|africans|mexicans|cripples|disabled))"
_ALL = r"(?:all |just |nothing but |no better than |little more than |a bunch of |like |worse than |basically |really |such )*"
PATTERNS = [(k, re.compile(r"(?<![\w'])(?:" + x + r")(?![\w'])")) for k, x in (
    ("threat", _MEAN + r" (?:[\w'-]+ ){0,2}?(?:kill|murder|hurt|stab|strangle|choke|maim|cripple|bury|slap|gut|drown|beat|skin|punch|destroy) (?:you|u|your (?:whole )?(?:family|kids|children|wife|husband|mother))"),
    ("threat", _MEAN + r" (?:[\w'-]+ ){0,2}?(?:murder|strangle|stab|slap|beat up|shoot|hang|drown) (?:him|her|that (?:man|woman|girl|boy))"),
    ("threat", _MEAN + r" (?:[\w'-]+ ){0,2}?(?:break|smash|crack|cut|slit|slash|burn|bash|rip|knock|kick|cave|crush|bust|wring|tear) (?:[\w'-]+ ){0,1}?(?:your|his|her|their) (?:[\w'-]+ )?" + _LIMB),
    ("threat", r"may (?:you|he|she|they) (?:[\w'-]+ ){0,2}?(?:choke|rot|die|burn|drown|suffer|bleed)|" + _MEAN + r" (?:[\w'-]+ ){0,1}?(?:break|smash|crush|cut off|chop off) (?:every|each|all|both)(?: of)? (?:[\w'-]+ )?(?:bones?|fingers?|teeth|tooth|ribs?|limbs?|legs?|arms?|knees?)"),
    ("threat", r"(?:hope|wish|pray)(?: that)? (?:you|he|she|your (?:[\w'-]+ ){1,3}?)(?: (?!didn't|don't|won't|not|never|doesn't)[\w'-]+){0,3}? ?(?:dies?|burns?|rots?|suffers?|chokes?|bleeds?|drowns?|drops? dead|were dead|gets? (?:cancer|hit by|run over|raped|beaten|sick)|never wakes? up|falls? (?:down|off|under))"),
    ("threat", r"(?:you|he|she) (?:really |just |all )?(?:should|ought to|deserves? to|needs? to) (?:[\w'-]+ )?(?:die|rot|suffer|hang|bleed|drown|be (?:dead|shot|hanged|beaten|whipped|stabbed|strangled))"),
    ("threat", r"drop dead|rot in hell|burn in hell|go (?:and )?(?:die|hang yourself|drown yourself|jump off a (?:bridge|cliff|roof))|(?:kill|hang|drown|shoot) yourself|end your (?:own )?(?:miserable )?life|better off dead|wish you were dead|world (?:[\w'-]+ ){1,4}without you|you(?:'re| are) (?:a )?dead (?:man|meat|woman)"),
    ("threat", r"know where you (?:live|sleep|park)|know where your (?:kids|children|family|wife|husband|daughter|son) [\w'-]+|you(?:'ll| will) (?:never|not|wish you) (?:[\w'-]+ )?(?:walk|breathe|wake up|see tomorrow|leave alive)|you(?:'ll| will) (?:be sorry you were|pay with your|wish you were dead|wish you had never been born)"),
    ("hate", _WHO + r" (?:are|is) " + _ALL + r"(?:a )?(?:vermin|animals|apes|rats|pigs|dogs|parasites|cockroaches|maggots|lice|monkeys|pests?|savages|filth|scum|trash|garbage|subhumans?|plague|disease|cancer|virus|degenerates|criminals|thieves|liars|terrorists|rapists|inferior|dirty|filthy|lazy|stupid|too (?:stupid|lazy|dirty|dumb)|disgusting)"),
    ("hate", r"(?<!rats )(?<!mice )are " + _ALL + r"(?:vermin|cockroaches|maggots|subhumans?|savages)"),
    ("hate", _WHO + r" (?:[\w'-]+ )?(?:should|ought to|need to|must|have to|deserve to) (?:all )?be (?:driven out|deported|exterminated|gassed|shot|locked up|wiped out|put down|castrated|sterili[sz]ed|hanged|burned|burnt|expelled|caged|drowned|rounded up|whipped|beaten|kicked out|thrown out)"),
    ("hate", _WHO + r" (?:don't|do not|doesn't|never) (?:belong (?:here|in this|among|near|with us)|deserve (?:to live|rights|to vote|to breathe))|(?:back to|from) where(?:ver)? (?:you|they|your kind|their kind) (?:came|crawled|come)|go back to your (?:own )?(?:country|jungle|cave|hole)"),
    ("hate", r"(?:hate|despise|can't stand|don't trust|never trust|never hire|wouldn't hire|don't hire|get rid of|sick of) (?:all )?" + _WHO + r"|only good (?:[\w'-]+ ){1,3}(?:is|are) (?:a )?dead"),
    ("sexual", r"(?:want|love|like|need|dying|dream(?:ing)? of|think(?:ing)? (?:of|about)|let me|wanna|gonna|going|i'll|i would|i'd|wish i could)(?: to)? (?:[\w'-]+ ){0,2}?(?:fuck(?:ing)?|lick(?:ing)?|suck(?:ing)?|undress(?:ing)?|grop(?:e|ing)|spank(?:ing)?|fondl(?:e|ing)|sleep with|bend|feel up) (?:you|her|him|your (?:[\w'-]+ )?" + _BODY + r")"),
    ("sexual", r"(?:touch(?:ing)?|kiss(?:ing)?|tast(?:e|ing)|squeez(?:e|ing)|strok(?:e|ing)|grab(?:bing)?|see|feel(?:ing)?|star(?:e|ing) at|rub(?:bing)?) (?:[\w'-]+ ){0,1}?your (?:[\w'-]+ )?(?!body of)" + _BODY),
    ("sexual", r"(?:show|send) me (?:a (?:photo|picture) of )?(?:your|some|those) (?:[\w'-]+ )?(?:" + _BODY + r"|nudes?|naked)|(?:take|slip|rip|pull|tear) (?:off your (?:clothes|bra|panties|knickers|skirt|blouse|dress|underwear|shirt)|your (?:clothes|bra|panties|knickers|skirt|blouse|dress|underwear|shirt) (?:off|up|down))|(?:pictur|imagin|dream|think|fantasi[sz])[a-z]* (?:of |about )?you (?:[\w'-]+ )?(?:naked|nude|undressed|topless|bent over|on your knees|in my bed|moaning|on top of me)"),
    ("sexual", r"(?:mak|get|got|turn)[a-z]* me (?:so |really |all )?(?:hard|horny)|(?:his|her|my|your) (?:[\w'-]+ )?(?:cock|dick|pussy|tits|boobs|nipples?|clit|penis|vagina|erection) (?:[\w'-]+ ){0,4}?(?:inside|in(?:to)? her|in(?:to)? his|throbb\w+|dripping|sucked|licked|moan\w*|thrust\w*)|(?:sucked|licked|stroked|swallowed|sucking|licking|stroking|thrust) (?:[\w'-]+ ){0,2}?(?:his|her|my|your) (?:[\w'-]+ )?(?:cock|dick|pussy|tits|boobs|nipples?|clit|penis|vagina|erection|balls)"),
    ("insult", r"you(?:'re| are) (?:[\w'-]+ )?(?:a |an |such a )(?:[\w'-]+ )?(?:disgrace|embarrassment|failure|nobody|joke of a|waste of|sorry excuse|pathetic excuse|disease|cancer|parasite)|(?:nobody|no one) (?:[\w'-]+ )?(?:likes|wants|loves|needs|would miss|will miss) you|you(?:'re| are) (?:[\w'-]+ )?too (?:stupid|dumb|thick|dim|dense|useless) to|how (?:stupid|dumb|thick) (?:are you|can you|do you have)|(?:brains?|iq|intelligence|wit) of an? [\w'-]+|you (?:disgust me|make me sick|people make me)|crawl back (?:to|under|into)|shut your (?:[\w'-]+ )?(?:mouth|trap|face|gob|hole)"),
    ("threat", r"(?:put|fire|empty|lodge|plant|stick|ram) (?:a|an|this|my) (?:[\w'-]+ )?(?:bullet|knife|blade|axe|fist|boot|gun|brick) (?:in|into|through|to|up) (?:you|your|his|her|their|him|them)|put a bullet (?:in|into|through) (?!the\b|a\b|an\b|each\b|every\b|this\b|front\b|it\b|my\b)[\w'-]+|(?:cut|wipe|slap|knock|smack|beat|punch|carve) (?:that|the|this|your) (?:[\w'-]+ )?(?:grin|smile|smirk|look|face|sneer) off"),
    ("threat", r"make (?:you|him|her|them) (?:all )?(?:suffer|bleed|beg|scream|wish)|your (?:kids|children|family|wife|husband|daughter|son|mother|parents) (?:will|are going to|is going to|can) (?:all )?(?:see it|watch|find you|cry|suffer|pay|miss you|bury)|(?:and )?your (?:whole )?(?:family|kids|children|house|wife|husband) (?:will )?(?:burns?|dies?|rots?|bleeds?)"),
    ("threat", r"(?:i'll|i will|we'll|someone will) be (?:right )?(?:behind|waiting for|coming for|following) you|die in (?:a|hell|pain|agony|your)|(?:hope|wish) (?:[\w'-]+ ){0,5}burns? (?:in|to|with)"),
    ("threat", r"(?:schlag|hau|brech|prügel|stech|reiß|tret)[a-zß]* (?:ich |wir |man )?(?:dir|dich|euch) |bring[a-z]* (?:ich )?(?:dich|euch|ihn) um|halt[a-z]* (?:endlich )?(?:dein|deine|die) (?:[\w-]+ )?(?:maul|fresse|klappe|schnauze)|(?:te|vous) (?:casser|péter|défoncer|buter|crever|tuer|éclater|fracasser|briser)|ferme[z]? (?:ta|vos|vous) (?:[\w-]+ )?gueule|te (?:voy|vamos) a (?:partir|romper|matar|reventar|destrozar|cortar|quemar)|(?:partirte|romperte|matarte|reventarte)|te (?:parto|rompo|mato|reviento)|partir la cara|ojalá te (?:mueras|pudras)"),
    ("hate", r"(?:thieves|liars|criminals|savages|animals|parasites|killers|beggars|lazy|dirty|violent|stupid) by (?:blood|nature|birth)|too [\w'-]+ by nature|(?:thieves|liars|criminals) and (?:thieves|liars|criminals|beggars)|they (?:all )?(?:stink|smell|steal|lie|breed|cheat) and (?:they )?(?:all )?(?:stink|smell|steal|lie|breed|cheat)|(?:keep|stay|kept|throw|get|them|people)(?: [\w'-]+){0,5} away from (?:our|decent|normal|honest) (?:children|kids|women|girls|people|families)"),
    ("hate", r"(?:they|people|kind|sort|lot|[\w'-]+s) (?:all )?(?:should|ought to|must|need to|deserve to) (?:all )?be (?:driven out|put down|exterminated|gassed|rounded up|wiped out|castrated|sterili[sz]ed|caged|drowned|deported)|belongs? in (?:cages|a cage|zoos|a zoo|camps|the gutter|ovens)|dead (?:one|[\w'-]+)(?: of(?: [\w'-]+){1,4})? is the only good|(?:put|shot|culled) (?:down )?like (?:[\w'-]+ )?(?:dogs|cattle|rats|vermin|animals)"),
    ("hate", r"are (?:a|the) (?:disease|plague|cancer|curse|stain) (?:and|on|of|to|upon|in) (?:this|our|the|that|they|every)|(?:don't|do not|never) want (?:any |those |these |your )?(?:[\w'-]+ ){1,3}(?:here because|here they|near our|in our (?:street|town|country|school|block|building))|(?:your|their) kind (?:crawled|came|belongs?|should|again|here|around|stinks?|will never)"),
    ("hate", r"(?:gehör[a-z]* (?:alle |allesamt )?(?:weggesperrt|abgeschoben|vergast|eingesperrt|rausgeworfen|vertrieben)|sind (?:alle |nur |doch )*(?:ungeziefer|abschaum|dreck|untermenschen|parasiten|ratten))|sont (?:tous |toutes |que |rien que )*(?:de la |des |du )?(?:vermine|parasites|racaille|déchets|rats|cafards|ordures)|qu'on les (?:chasse|expulse|renvoie|enferme|tue|extermine)|son (?:todos |todas )?(?:una |unos |unas )?(?:plaga|ratas|parásitos|basura|escoria|cucarachas)|(?:echar|expulsar|matar|eliminar)los a todos"),
    ("sexual", r"(?:naked|nude|undressed|topless|spread|bent) (?:out |over )?(?:on|over|across|in|under) my (?:desk|bed|lap|sofa|couch|chair|car|table)|your legs (?:apart|open|spread|wide)|(?:sit|sat|sitting|bounce|climb) (?:down )?(?:on|onto) my (?:lap|face|knee|dick|cock)|my (?:fingers?|tongue|cock|dick) (?:[\w'-]+ ){0,2}?(?:inside you|up your|between your|all over you|in you)"),
    ("sexual", r"(?:nothing|no (?:panties|underwear|bra|knickers)) (?:on )?(?:under|underneath|beneath) (?:that|your|the|those|her) (?:[\w'-]+ )?(?:skirt|dress|blouse|shirt|jeans|coat|top|clothes)|wear (?:the|that|your) (?:[\w'-]+ )?(?:short|tight|tiny|low|skimpy) (?:one|skirt|dress|top|blouse|shorts)|(?:cock|dick) in (?:her|his|your|my) (?:mouth|ass|hand|pussy)"),
    ("sexual", r"(?:hard|wet|horny|turned on) (?:just |only |from |by |when |every time )+(?:i )?(?:read|see|hear|think|watch|look|reading|seeing|hearing|thinking|watching|looking)[a-z]* |(?:want|dying|love|need|going) to (?:[\w'-]+ )?(?:taste|ride|mount|undress|strip|lick) you|(?:come|sneak|slip) (?:up |over |back )?(?:to|into) my (?:room|bed|bedroom) (?:tonight|alone|naked|after|and (?:take|let|bring))"),
    ("insult", r"(?:a|an|my|the|that) (?:[\w'-]+ ){1,3}(?:has|have|had|shows|with) more (?:sense|brains?|intelligence|wit|talent|spine|decency|charm|personality) than (?:you|your)|(?:piensa|sirve|vale|sabe) (?:mejor|más) que tú|learn (?:how )?to (?:read|write|count|think|spell|add)(?: [\w'-]+)? before you|how do you (?:even |ever |still |manage to )+(?:dress|breathe|feed|tie|function|hold|keep|get (?:up|out|dressed))"),
    ("insult", r"(?:your|his|her) (?:own )?(?:mother|mum|mom|parents|father|dad) (?:[\w'-]+ ){0,3}?(?:cry|cries|cried|ashamed|regrets?|regretted|weeps?|embarrassed|disappointed|should have)|son of a (?:bitch|whore)|shut the (?:[\w'-]+ )?up|you(?:'re| are) (?:by far )?the (?:worst of (?:them|all|the lot)|dumbest|stupidest|most (?:useless|stupid|incompetent|pathetic|worthless))|rien dans la tête|nichts im kopf"),
)]
#: Words of which a message must hold one before the patterns are tried.
TRIGGER = set("""kill murder hurt stab strangle choke maim cripple bury slap gut drown beat skin punch destroy shoot hang break smash crack cut slit slash burn bash rip knock kick cave crush bust wring tear hope wish
pray die dies rot suffer dead bleed deserve deserves yourself life without live sleep park kids children family walk breathe wake sorry hole cave jungle jump vermin animals apes rats pigs dogs
parasites cockroaches maggots lice monkeys pest pests savages filth scum trash garbage subhuman subhumans plague disease cancer virus degenerates criminals thieves liars terrorists rapists inferior
dirty filthy lazy stupid disgusting driven deported exterminated gassed shot locked wiped put castrated sterilised sterilized hanged burned burnt expelled caged drowned rounded whipped beaten kicked
thrown belong rights crawled came country hate despise stand trust hire rid sick fuck fucking lick licking suck sucking undress undressing grope groping spank spanking fondle fondling bend breasts
breast tits boobs nipple nipples thigh thighs pussy cock dick ass arse butt clit crotch body cunt panties bra knickers nude nudes naked clothes skirt blouse dress underwear shirt undressed topless
bent knees bed moaning hard horny bullet knife blade axe fist boot gun brick cry cries cried ashamed regret regrets weeps embarrassed disappointed bitch whore worst dumbest stupidest dress breathe
feed tie function sense spell legs naked lap desk short tight tongue steal stink smell breed cheat cages cage dead behind waiting maul fresse klappe schnauze dir dich euch te vous gueule sind gehören
gehört partir matarte romperte ojalá cara piensa sirve vale bleed beg scream curse stain wet sucked licked stroked swallowed penis vagina erection balls disgrace embarrassment failure nobody joke
waste excuse parasite likes wants loves needs miss dumb thick dim dense useless brain brains iq intelligence wit disgust crawl shut smile grin head pay sleep nature learn belongs vermine racaille
déchets cafards ordures qu'on plaga ratas parásitos basura escoria cucarachas echarlos expulsarlos matarlos eliminarlos""".split())

#: Each pattern's own of these words: those that begin as a word of it does. It is tried where a message has one.
NEEDS = [frozenset(w for w in TRIGGER if w[:3] in {c[:3] for c in re.findall(r"[^\W\d_]{3,}", p.pattern)}) for _, p in PATTERNS]

MILD = {"fat", "lying", "dumb", "sale", "goddamn", "useless", "miserable"}  # no insult alone
SELF = {"i'm", "i", "am", "ich", "myself", "je", "suis", "soy", "me"}
AIMED = {"you", "your", "you're", "youre", "yours", "u", "dein", "deinem", "du", "dich", "dir", "tu", "ta", "ton", "te", "tú", "toi", "espèce", "pedazo", "bist", "eres", "sois", "êtes", "es-tu", "vous", "ihr", "euch"}
ABOUT = {"policy", "training", "filter", "harassment", "discussed", "word", "words", "wording", "survey", "clinic", "course", "definition", "dictionary", "complaints", "insulting", "novel", "persecution", "bug", "loop", "printer", "machine", "configure", "form", "build", "column"}
LOOK = str.maketrans("аеорсухіјѕԁԛԝһոցьѵɡıοαεικνρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdqwhngbvgioaeikvptuABEZHIKMNOPTYXABEKMHOPCTYXIJS")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
THING = re.compile(r"(?:\bit's|\bit is|\bthis is|\bthis thing is|\bthat's) (?:(?:such|just|still|really|so|a|an|the|one) )*(?:[\w'-]+ )?$")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎‪-‮︀-️]")
TOKEN = re.compile(r"[^\W_]+(?:['’*$@!]+[^\W_]+)*[*$@]*|[*$@][\w*$@!'’]*\w[*$@]*")
SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_]|[*$@013457])(?:([ .-])(?:[^\W\d_]|['’*$@013457]))(?:\1(?:[^\W\d_]|['’*$@013457]))+(?![\w'’])")
HAN_SPAN = re.compile("[぀-ヿ㐀-鿿]")


class Trie:
    """Words as nested tables; walk() steps a Levenshtein automaton along it."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def walk(self, word: str, most: int, head: bool = True) -> list[tuple[str, int]]:
        """The words within `most` edits of `word`; `*` in it stands for any letter at no cost. The automaton's
        state is a row of edit distances, dropped where all exceed `most`. With `head` the first letter must be
        right or masked."""
        out, n = [], len(word)
        row = list(range(n + 1))
        if word[0] == "*" or not head:
            stack = [(self.root, row, "", None)]
        elif word[0] in self.root:
            stack = [(self.root[word[0]], [1, *range(n)], word[0], row)]
        else:
            return []
        while stack:
            node, row, last, before = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= most:
                        out.append((child, row[n]))
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    w = word[j - 1]
                    cost = 0 if w == c or w == "*" else 1
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + cost)
                    if before is not None and j > 1 and c == word[j - 2] and last == w:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    stack.append((child, new, c, row))
        return out


def _cuts(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out. Words within `most` edits of each other share one of these."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _phrases(kind: str, texts: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    return [(kind, tuple(t.split())) for t in texts if t]


class Lexicon:
    def __init__(self):
        self.phrases = _phrases("hate", HATE) + _phrases("threat", THREAT) + _phrases("sexual", SEXUAL)
        words = {w for _, p in self.phrases for w in p if w != "group"}
        self.terms = {**{w: "slur" for w in SLUR}, **{w: "person" for w in PERSON}}
        words |= {w for w in TRIGGER if len(w) >= 5}  # the patterns' own words, misspelled too
        self.exact = {w for w in words if w not in self.terms}
        self.alone = {p[0] for _, p in self.phrases if len(p) == 1}
        self.plain = set(PLAIN)
        self.trie = Trie(words | set(self.terms))
        self.longest = max(map(len, words | set(self.terms)))
        self.reach = [set(), *({c for w in words | set(self.terms) for c in _cuts(w, k)} for k in (1, 2))]
        self.first: dict[str, list] = {}
        for kind, p in self.phrases:
            self.first.setdefault(next(w for w in p if w != "group"), []).append((kind, p))

    def near(self, token: str) -> frozenset[str]:
        """Lexicon words a token may stand for."""
        forms = {token}
        if re.search(r"(.)\1\1", token):
            forms |= {re.sub(r"(.)\1{2,}", r"\1", token), re.sub(r"(.)\1{2,}", r"\1\1", token)}
        if token[0] == "*" == token[-1]:  # emphasis
            forms |= {f.strip("*") for f in forms}
        forms = {f for f in forms if f.strip("*")}
        if re.search(r"[0-9$@!]", token) and re.search(r"[^\W\d_]", token):
            forms |= {f.translate(LEET) for f in list(forms)} | {f.replace("1", "l").translate(LEET) for f in list(forms)}
        found: set[str] = set()
        for f in forms:
            if f in self.exact or f in self.terms:
                found.add(f)
                continue
            if f in self.plain:  # bars inexact matches only
                continue
            stars = f.count("*")
            letters = len(f) - stars
            most = 0 if letters < (5 if stars else 4) else 1 if len(f) < 10 or stars else 2
            if len(f) > self.longest + most:
                continue  # longer than any lexicon word by more edits than allowed
            if not stars and (not most or self.reach[most].isdisjoint(_cuts(f, most))):
                continue  # no lexicon word is so near
            for w, d in self.trie.walk(f, most, head=False):
                # a word of a phrase is held by the others, one that is a phrase alone is not
                if d == 0 or len(w) >= (4 if w in self.terms else 7 if w in self.alone else 5):
                    found.add(w)
        return frozenset(found)


def unfold(text: str) -> str:
    text = INVISIBLE.sub("", text)
    text = unicodedata.normalize("NFKC", text).replace("’", "'")
    text = re.sub(r"^[>|\s]+", "", text, flags=re.M)
    if re.search("[Ͱ-ϿЀ-ӿ]", text):
        text = re.sub(r"\w+", lambda m: m[0].translate(LOOK) if re.search("[A-Za-z]", m[0]) or not re.search("[^Ͱ-ϿЀ-ӿ]", m[0].translate(LOOK)) else m[0], text)
    return SPACED.sub(lambda m: m[0].replace(m[1], ""), text)


def score(text: str, lexicon: Lexicon, memo: dict) -> tuple[float, str]:
    """Largest contextual score of a visible text and its kind. 1 and more is a case."""
    t = unfold(text)
    best, kind = 0.0, ""
    if HAN_SPAN.search(t):
        flat = re.sub(r"\s+", "", t)
        for h in HAN:
            if h in flat:
                best, kind = 1.0, "han"
                break
    raw = TOKEN.findall(t)
    toks = [w.lower() for w in raw]
    hits: list[frozenset] = []
    for w in toks:
        got = memo.get(w)
        if got is None:
            got = memo[w] = lexicon.near(w)
        hits.append(got)
    n = len(toks)
    plain = [w if not h or w in h else min(h) if len(h) == 1 else w for w, h in zip(toks, hits, strict=True)]
    cues = TRIGGER.intersection(plain)
    if cues:
        flow = " ".join(plain)
        for (k, pattern), needs in zip(PATTERNS, NEEDS, strict=True):
            if needs.isdisjoint(cues):
                continue
            for m in pattern.finditer(flow):
                near = flow[: m.start()].split()[-8:] + flow[m.end() :].split()[:9]
                v = 0.4 if ABOUT & set(near) and not AIMED & set(m[0].split()) else 1.0
                if v > best:
                    best, kind = v, k
    for i in [i for i, h in enumerate(hits) if h]:
        for w in hits[i]:
            for k, p in lexicon.first.get(w, ()):
                if _phrase(p, hits, toks, i, n):
                    v = 1.0 if len(p) > 1 or w not in lexicon.plain else 0.6
                    if k == "sexual" and len(p) == 1 and ABOUT & set(toks[max(0, i - 8) : i + 9]):
                        v *= 0.5
                    if v > best:
                        best, kind = v, k
            role = lexicon.terms.get(w)
            if role:
                v = _aimed(i, w, role, toks, raw, hits, lexicon, n)
                if v > best:
                    best, kind = v, "insult"
    return best, kind


def _phrase(p: tuple[str, ...], hits: list, toks: list, i: int, n: int) -> bool:
    """Whether the phrase stands around its first word at i; one word may stand between two of it."""
    lead = next(j for j, w in enumerate(p) if w != "group")
    if lead and i < 1:
        return False
    at = i + 1
    free = False
    for w in p[lead + 1 :]:
        if w == "group":
            free = True
            continue
        reach = 5 if free else 2
        for j in range(at, min(n, at + reach)):
            if w in hits[j] or toks[j] == w:
                at = j + 1
                break
        else:
            return False
        free = False
    return True


def _aimed(i: int, w: str, role: str, toks: list, raw: list, hits: list, lexicon: Lexicon, n: int) -> float:
    """A term's score from its window: who it is aimed at."""
    window = toks[max(0, i - 5) : i + 4]
    ahead = toks[max(0, i - 4) : i]
    roles = [next((lexicon.terms[w] for w in hits[j] if w in lexicon.terms), "") for j in range(max(0, i - 2), min(n, i + 3))]
    if SELF & set(ahead) and not AIMED & set(window):
        return 0.2
    if ABOUT & set(toks[max(0, i - 4) : i + 6]) and not AIMED & set(window):
        return 0.3
    if THING.search(" ".join(ahead) + " ") and not re.match(r"(?:like|of) you\b|(?:and|,)? ?you're\b", " ".join(toks[i + 1 : i + 4])):
        return 0.3  # said of a thing, whoever else is addressed nearby
    if ("it's" in ahead or "this" in ahead) and not AIMED & set(window):
        return 0.3
    double = sum(r == "person" for r in roles) + sum(r == "slur" for r in roles) >= 2 and "person" in roles
    cue = " ".join(ahead)
    if role == "person" and (re.search(r"such an? ?\w*$|what kind of$|bunch of$|is an? ?[\w-]*$|what an?$|only an? ?\w*$", cue) and not re.search(r"\bit is an?", cue)):
        return 1.0
    if AIMED & set(window):
        plain = role == "slur" and w not in MILD and {"you", "you're", "youre"} & set(ahead[-2:])
        return 1.0 if role == "person" or double or plain else 0.7
    if double:
        return 1.0
    return 0.5


def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon()
    memo: dict = {}
    for b in batches:
        if len(memo) > 200_000:
            memo.clear()
        got = [score(visible(t), lexicon, memo) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": [s for s, _ in got], "kind": [k for _, k in got]})


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, kind), one row per row of documents(doc_id, text, source). The score is the largest of
    the message's hits, 0 where there is none; null and empty texts score 0. A case scores 1 or more. Other columns
    are ignored; repeated rows stay repeated; an empty table gives no rows."""
    x = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return spread(x).mapInPandas(score_batches, "doc_id long, source string, score double, kind string")


def plain_source(c):
    """Source names without case, blanks and underscores: `Desk_Archive ` is `desk-archive`."""
    return F.regexp_replace(F.lower(F.trim(c)), "[_ ]+", "-")


def rates(scores: DataFrame) -> DataFrame:
    """Messages, cases and their rate per source; a missing source is `(none)`."""
    x = scores.groupBy(F.coalesce(plain_source(F.col("source")), F.lit("(none)")).alias("source"))
    return x.agg(F.count(F.lit(1)).alias("messages"), F.sum((F.col("score") >= 1).cast("long")).alias("cases"), F.round(F.avg((F.col("score") >= 1).cast("double")), 6).alias("rate"))
