"""The word lists of problem 8, beside the lexicon table: set phrases that are decisive, constructions of word classes, words
that depend on their context, and the exceptions. Fixed values, in folded spelling (lower case, no accents), one language
after the other. They are general vocabulary: no sentence of a test document belongs here."""

#: Insults: words for a person; they count in a sentence that speaks to or about one.
INSULT_WORDS = """
idiot idiots moron morons imbecile imbeciles cretin bastard bastards arsehole asshole dumbass dickhead shithead scumbag
halfwit tosser wanker prick twat cunt bitch whore slut loser dimwit nitwit jackass dipshit fuckwit motherfucker pathetic worthless scum
vollidiot trottel schwachkopf dummkopf arschloch wichser mistkerl drecksau drecksack hurensohn schlampe vollpfosten
missgeburt arsch depp versager
connard connasse salaud salope abruti encule enculee imbecile cretin batard ordure debile tocard
imbecil idiota gilipollas cabron capullo pendejo mamon cretino subnormal puta perra zorra payaso
stronzo coglione bastardo deficiente otario babaca cuzao merda vaffanculo cretino cornuto
идиот идиотка дурак дура кретин ублюдок сволочь тварь мразь придурок дебил сука козел скотина гнида подонок урод
傻逼 傻瓜 白痴 笨蛋 混蛋 王八蛋 贱人 蠢货 废物 垃圾 人渣 畜生
馬鹿野郎 バカ アホ クズ 間抜け 死に損ない ゴミ野郎 この野郎
"""
INSULT_PHRASES = """
filthy pig, disgusting pig, piece of shit, pauvre type, fils de pute, hijo de puta, testa di cazzo, figlio di puttana, filho da puta
"""

#: Abuse that needs nothing else: set phrases of orders and wishes of harm.
ABUSE = """
fuck off, fuck you, go to hell, drop dead, shut your mouth, shut the fuck up, kill yourself, hang yourself, rot in hell, screw you, piss off
halt die fresse, halt die schnauze, halt dein maul, halts maul, verpiss dich, fick dich, leck mich am arsch, geh sterben, verrecke
ferme ta gueule, ta gueule, va te faire foutre, va te faire enculer, va crever, nique ta mere, va en enfer
vete a la mierda, vete al infierno, callate la boca, cierra el pico, ojala te mueras, que te jodan, vete al carajo
vaffanculo, vai a farti fottere, chiudi il becco, vai all inferno
vai se foder, cala a boca, vai para o inferno, vai a merda
заткнись, пошел ты, иди к черту, чтоб ты сдох, сдохни, я тебя убью, убью тебя, пошла ты, закрои рот
去死, 滚开, 滚蛋, 操你, 他妈的, 闭嘴, 我要杀了你, 杀了你, 宰了你
死んでしまえ, 殺してやる, ぶっ殺す, くたばれ, 消え失せろ
"""

#: Hate that needs nothing else; most of it is a construction of a group and what is said of it.
HATE = """
exterminate them, wipe them out, gas them, ethnic cleansing now, back where they came from
raus mit den auslandern, auslander raus, retournez dans votre pays, vuelvan a su pais, fuori gli stranieri, fora com os imigrantes
убираитесь из нашеи страны, всех их надо выгнать, они недочеловеки, они все воры
滚出我们的国家, 都是寄生虫, 都是小偷, 低等民族, 都该死, 应该被赶走
外国人は国へ帰れ, 出て行け外国人, 害虫どもめ, 劣等民族, 皆殺しにしろ
"""

#: Explicit words and set phrases of sexual content.
SEXUAL = """
fuck me, fucked her, fucked him, they fucked, blowjob, blow job, handjob, cumshot, gangbang, hardcore porn, sucked him off, jerked off, spread her legs,
spread her thighs
fickten, ficken, vogelten, bumsten, baiserent, follaron, follando, scopavano, scopare, foderam, transaram
трахал, трахались, трахнул, минет, кончил в нее, 口交, 色情片, エロ動画, セックスした, フェラチオ
"""

#: Classes of words that constructions are made of.
CLASSES = {
    "contempt": """vermin parasites animals beasts savages subhuman subhumans scum filth rats cockroaches lice pests plague cancer criminals thieves liars rapists
        murderers terrorists degenerates ungeziefer parasiten schmarotzer abschaum untermenschen diebe verbrecher ratten gesindel pest plage tiere vermine
        animaux racaille voleurs criminels sauvages plaga parasitos animales alimanas ladrones criminales escoria ratas salvajes parassiti ladri feccia
        animali criminali parasitas ladroes animais""",
    "dull": "stupid dumb lazy dirty primitive dumm faul dreckig bete betes stupides paresseux sales tontos estupidos vagos sucios",
    "expelled": """driven chased thrown deported expelled exterminated hunted eradicated enslaved vertrieben ausgewiesen abgeschoben vernichtet ausgerottet verjagt
        chasser expulser exterminer eliminer renvoyer echarlos expulsarlos exterminarlos eliminarlos matarlos echar expulsar exterminar""",
    "group": """immigrants migrants foreigners refugees newcomers outsiders gypsies muslims jews christians believers infidels blacks gays lesbians homosexuals women
        auslander fremden fluchtlinge zugereisten migranten juden muslime zigeuner etrangers immigres refugies juifs musulmans arabes noirs gitans
        extranjeros inmigrantes migrantes refugiados judios musulmanes gitanos negros moros people folk""",
    "body": """fingers finger legs leg neck face teeth skull head nose jaw arms arm bones throat hands ribs knees kneecaps genick hals fresse zahne schadel kopf nase
        arme knochen gesicht beine doigts jambes gueule dents crane tete nez bras os visage dedos piernas cara dientes cabeza nariz brazos huesos cuello""",
    "harm": """kill murder strangle stab shoot beat beats hurt die dead died suffer rot choke drown senseless umbringen toten erwurgen erschiessen krepierst stirbst umfallst
        tuer buter massacrer egorger creves mort morte matar matarte destrozarte mueras murieras muerto muerta""",
    "beast": "pig swine worm dog rat snake cow cockroach maggot leech garbage trash scum filth vermin schwein hund ratte dreck mull porc chien ordure cerdo perro rata basura",
    "threat": "regret sorry pay live sleep wohnst habites vives bereuen regretter arrepentiras",
    "home": "house houses home homes shop shops church churches mosque mosques temple temples synagogue synagogues village villages quarter",
    "better": "cleaner better safer sauberer besser sicherer propre meilleur sur limpio mejor seguro",
    "organ": "cock dick pussy clit cunt tits penis vagina nipples schwanz muschi titten seins polla tetas pezones",
    "bare": "naked nude nackt nackte nue nu nus desnuda desnudo desnudos nuda nudo",
    "lust": """moan moaned moaning gasped panting thrust thrusting penetrated orgasm climax horny aroused stohnte stohnten eindrang zustiess gemissait gemit penetrait
        gemia gemian penetraba jadeaba correrse ansimava""",
    "porn": "porn porno pornos pornography sex oral anal erotic escort xxx",
    "birth": "born",
    "leap": "jump",
    "act": "finger fingers tongue cock dick thrust thrusting came slid pushed pounded",
    "offer": """uncensored horny hot clips videos nude amateur offers offer unzensiert unzensierte geil geile geilen censure chaud chauds chaude censura calientes caliente
        caldo calde quente quentes""",
}

#: Constructions: (name, category, classes that must all stand in the sentence, expression over the folded sentence; <class> is any word of it).
#: Subjects are told by grammar, so that groups of any name are found; "you", "I" and "we" are persons, animals aren't groups.
CONSTRUCTIONS = (
    ("group is", "hate", ("contempt",),
     r"(?<!you )(?<!we )(?<!rats )(?<!mice )(?<!moths )\b(?:are|sind|sont|son|sono|sao)(?: (?!not\b|no\b|nicht\b|pas\b)\w+){0,3}? <contempt>\b(?! (?:free|like|that eat))"),
    ("all group", "hate", ("contempt",), r"\b(?:all|alle|alles|tous|todos|tutti|nothing but|nichts als|rien que)(?: (?:a|of|the|these|those|just|dirty|die|diese|des|de|les|son|unos|unas))*? <contempt>\b"),
    ("group breeds", "hate", ("contempt",), r"\b(?:breed|breeding|multiply|spread|vermehren|pullulent|reproduisent|reproducen)(?: \w+){0,2} (?:like|wie|comme|como)(?: \w+){0,2} (?:<contempt>|rabbits|flies)\b"),
    ("group too dull", "hate", ("dull",), r"(?<!you )(?<!we )\b(?:are|sind|sont|son)(?: \w+){0,2}? (?:too|zu|trop|demasiado) <dull> (?:to|um|zum|pour|para)\b"),
    ("born to", "hate", ("birth",), r"\bborn (?:to (?:steal|lie|beg|cheat|serve|kill)|criminals|thieves|liars)\b"),
    ("group out", "hate", ("expelled",),
     r"\b(?:should|must|ought to|need to|have to) (?:all )?be <expelled>\b|\b(?:faut|hay que|debemos)(?: (?:les|tous|les tous|a))? <expelled>\b|\b<expelled> (?:werden )?(?:mussen|sollten|gehoren)\b|\b(?:mussen|sollten|gehoren)(?: \w+){0,4} <expelled>\b"),
    ("send group", "hate", ("group",), r"\b(?:send|drive|throw|kick|chase|ship|keep|get|lock|hunt|deport)(?: \w+){0,2}? <group>(?: \w+){0,3} (?:back|out|away|up|off|behind)\b"),
    ("kill group", "hate", ("group", "harm"), r"\b(?:kill|murder|shoot|hang|gas|burn) (?:all |every )(?:the |those |these )?<group>\b"),
    ("world without", "hate", ("better",),
     r"\b<better>(?: \w+){0,3} without (?:the|those|these|all|any)\b|\bohne (?:die|diese)\b(?: \w+){0,15}? <better>\b|\bsans (?:les|ces)\b(?: \w+){0,15}? <better>\b|\bsin (?:los|las|esos|esas)\b(?: \w+){0,15}? <better>\b"),
    ("burn homes", "hate", ("home",), r"\b(?:should|must|let s|let us|deserve|deserves|ought to)\b(?: \w+){0,3} (?:burn|torch|smash|blow up|destroy|loot)\b(?: \w+){0,4} <home>\b"),
    ("break body", "abuse", ("body",),
     r"\b(?:break|smash|cut|crush|snap|bash|punch|kick|slit|rip|tear|twist|knock)(?: \w+){0,2}? your (?:\w+ )?<body>\b"
     r"|\b(?:brech|schlag|zertrumm|hau|polier|stopf)\w*(?: \w+){0,2}? (?:dir|euch|deine?n?)(?: \w+){0,3}? <body>\b|\b(?:dir|euch)(?: \w+){0,3} <body> (?:brechen|einschlagen|ein|polieren)\b"
     r"|\b(?:te|vous)(?: \w+)? (?:casse|casser|peter|briser|exploser|defoncer|arracher|couper)(?: \w+){0,2}? <body>\b"
     r"|\b(?:romper|partir|reventar|cortar|arrancar|quebrar)te(?: \w+){0,2}? <body>\b|\bte (?:rompo|parto|reviento|corto|voy a (?:romper|partir|cortar))(?: \w+){0,2}? <body>\b"),
    ("kill you", "abuse", ("harm",),
     r"\b(?:i|we|they|somebody|someone)(?: \w+){0,3} (?:kill|murder|strangle|stab|shoot|beat|beats|hurt) (?:you|u)\b"
     r"|\b(?:ich|wir)(?: \w+){0,2} (?:dich|euch)(?: \w+){0,3} (?:umbringen|toten|erwurgen|erschiessen)\b|\b(?:te|vous) (?:tuer|buter|massacrer|egorger)\b|\b(?:te voy a|te vamos a) <harm>\b|\bvoy a matarte\b"),
    ("wish death", "abuse", ("harm",),
     r"\b(?:hope|wish|pray)(?: \w+){0,3} (?:you|your \w+)(?: \w+){0,3} <harm>\b|\b(?:hope|wish)(?: \w+){0,3} <harm> you\b"
     r"|\b(?:nobody|no one)(?: \w+){0,2} miss you\b(?: \w+){0,15}? <harm>\b|\b(?:niemand|keiner)\b(?: \w+){0,15}? dich vermissen\b(?: \w+){0,15}? <harm>\b|\bpersonne ne te regrett\w+\b(?: \w+){0,15}? <harm>\b|\b<harm>\b(?: \w+){0,15}? personne ne te regrett\w+|\bnadie te (?:echar|extranar)\w+\b(?: \w+){0,15}? <harm>\b"),
    ("jump", "abuse", ("leap",), r"\b(?:favou?r|should|please|go|just)\b(?: \w+){0,6}? jump (?:off|from|out|in front)\b"),
    ("you beast", "abuse", ("beast",),
     r"\byou (?:are|re) (?:(?!not\b|no\b)\w+ ){0,3}?<beast>\b|\byou (?:\w+ )?(?:filthy|dirty|ugly|fat|stupid|miserable|disgusting|spineless|little|worthless) <beast>\b|\bwhat an? (?:\w+ )?<beast> you are\b"
     r"|\bdu (?:bist (?:ein |eine )?)?(?:\w+ )?<beast>\b|\btu es (?:un |une )?(?:\w+ )?<beast>\b|\b(?:sale|espece de) <beast>\b|\beres (?:un |una )?<beast>\b"),
    ("threaten", "abuse", ("threat",),
     r"\b(?:make you|you will|you ll) (?:(?!not\b|never\b)\w+ ){0,2}?(?:regret|be sorry|pay for)\b|\b(?:know|find out|found out) where you (?:live|sleep)\b|\bweiss wo du wohnst\b|\bsais ou tu habites\b|\bse donde vives\b"
     r"|\b(?:wirst|werdet) (?:\w+ ){0,3}bereuen\b|\bte arrepentiras\b|\bvas (?:le )?regretter\b"),
    ("bare and lust", "sexual", ("bare", "lust"), ""),
    ("organ and lust", "sexual", ("organ", "lust"), r"\b(?:his|her|my|your|their|seine?|ihre?|son|sa|ses|sus?) <organ>\b"),
    ("organ of", "sexual", ("organ",), r"\b(?:lips|mouth|tongue|hand|hands|fingers)\b(?: \w+){0,3} (?:his|her|my|your) <organ>\b|\b(?:his|her|my|your) <organ>(?: \w+){0,4} (?:lips|mouth|tongue)\b"),
    ("inside", "sexual", ("act",), r"\b<act>(?: \w+){0,4} (?:inside|into|in) (?:her|him|me) ?(?!\w*self)\b(?= (?:while|until|again|hard\w*|deep\w*|and)\b|$)"),
    ("offer", "sexual", ("porn", "offer"), ""),
)

#: Words that only suggest a category; two of them, or one with its context, make a case.
HINTS = {
    "abuse": "disgusting spineless filthy miserable ignorant goddamn fucking elender elende pauvre asqueroso stupid bloody kill garbage gueule fresse mierda scheisse merde",
    "hate": "vermin parasites thieves ungeziefer parasiten vermine voleurs plaga ladrones parasitos slaves subhuman savages untermenschen паразиты 寄生虫 害虫",
    "sexual": "porn porno pornos orgasm nipples naked cock breast horny thighs moaned desnuda nackt stohnte nue seins pechos порно голая 做爱 性交 射精 裸体 裸 喘息",
}

#: Exceptions: where one stands in the sentence, the words there are mentioned, clinical, aimed at things or the speaker, or harmless.
EXCEPTIONS = """
sexual health, sex education, contraception, surgery, nurse, clinical, doctor, hospital, breast of, breast cancer, breast milk, breast feeding,
cock crowed, weathercock, kill the process, kill the job, killed the process, bloody good, bloody nose, stupid bug, stupid error, stupid mistake,
workaround, naked eye, naked wires, puppies, puppy, kennel, moths, as an insult, an insult, slander, the word, word for, the term, i am such an, i'm such an
sexuelle gesundheit, verhutung, ich idiot, ich bin so ein, das wort, als schimpfwort, schimpfwort, beleidigung, arzt
sante sexuelle, le mot, comme une insulte, une insulte, medecin
salud sexual, anticoncepcion, polillas, idiota soy, la palabra, como insulto, un insulto, medico
salute sessuale, la parola, saude sexual, a palavra
это слово, как оскорбление, врач, половое здоровье, 这个词, 作为侮辱, 医生, 性教育, という言葉, 侮辱として, 医師, 性教育
"""


def phrases(text: str) -> list[str]:
    return [p.strip() for p in text.replace("\n", ",").split(",") if p.strip()]
