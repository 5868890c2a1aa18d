"""Training sentences for the abuse model, built from frames and fillers in six languages.

The judged samples of a corpus are few. These sentences, written for this purpose and taken from no table, say what abuse,
threats, hatred and explicit language look like in general, and what looks alike but isn't: the same words of animals, health
or technology, or merely mentioned, and plain talk. ``|`` parts frames; ``{i}`` stands for an insult, ``{n}`` for who is spoken
of, ``{g}`` for a group, ``{v}`` for what it is likened to, ``{h}`` for a harm, ``{x}`` for an explicit word.
"""

from __future__ import annotations

from collections.abc import Iterator

EN = {
    "i": "idiot moron imbecile cretin asshole scumbag bastard dickhead shithead wanker dumbass jackass dipshit pig bitch whore slut loser cunt twat prick motherfucker douchebag retard coward fool",
    "n": "he|she|your brother|this man|tom|the boss", "g": "foreigners|immigrants|strangers|northerners|these people|islanders",
    "v": "vermin|parasites|filthy animals|scum|subhuman|rats|cockroaches",
    "h": "kill|strangle|stab|burn|hurt|beat|shoot|murder",
    "x": "fuck|fucking|fucked|cock|dick|pussy|tits|cum|cumming|porn|blowjob|nudes|horny|orgasm|dildo|masturbate|threesome",
    "bad": """{i}|you {i}|stupid {i}|you stupid cow|you dirty dog|i will drag you out of the house by your hair|crawl back into the hole you came from|every one of the {g} is a thief by birth|{g} have theft in the blood|send the {g} home in coffins|ship the {g} back in boxes|send them back in body bags|hey {i}|{i} you|oh what a {i}|we should gas the {g}|throw the {g} out|i will slit your throat|keep talking and you will be found dead|
{x}|hot {x} tonight|i want your {x}|
shut up you {i}|go to hell {i}|get lost you {i}|you are such a {i}|you are a worthless {i} and everybody knows it|{n} is a complete {i}|what a {i} {n} is|you fucking {i}|fuck you {i}|fuck off {i}|
you phoney little {i}|nobody likes a {i} like you|{n} was always a {i}|your mother raised a {i}|do us a favour and die {i}|i will {h} you|we will {h} you and your family|somebody should {h} you in your sleep|i will find you and {h} you|
i know where you live and i will make you suffer|watch your back i am coming for you|you will bleed for this|you will regret that you were born|i will break your neck|i will break every bone in your body|drink poison and die|
drink bleach you {i}|kill yourself|jump off a bridge nobody would miss you|nobody would miss you if you were dead|go hang yourself you {i}|all {g} are {v}|the {g} are {v} and should be driven out|{g} do not deserve to live|
send the {g} back where they came from|{g} should be wiped out|no decent person wants {g} in the house|{g} all steal and lie|{g} are born criminals|it is in their blood they are {v}|we would be better off without {g}|
exterminate the {g} they are {v}|{n} is fucking her hard on the bed|she sucks his cock and swallows|he licks her pussy until she moans|he licks her naked breasts|free porn tonight|horny wives want sex now|send me nudes|
i want to cum on your tits|they fuck all night long|her tits are hot and she is naked|watch hot naked teens masturbate|he has a hard cock for you|she moaned with his dick inside her|i will make you cum baby""",
    "fine": """you are welcome to visit us|you are right|you are late|how are you and where do you live|return the box by mail|age sex and body weight of each animal were noted|each pig was weighed and measured|height and body length were measured for each child|two bags of rice|crawl under the table|the blood test was fine|keep talking to the children|the birth of the {g}|
according to the report the train from the north to the south carried a few hundred people before the bridge closed|if one group walks to the lake and another follows after an hour which of them is first to the house|a man of the town paid a lot for a blue car without asking anyone|in the trial of last year the scientist grew some plants beside the wall while others kept only a few under glass|because it was late the teacher and all of the children went to the old station in the rain|does the company really work at the weekend so that everyone can see it|what is the best way to learn a language in a month|there are about two thousand residents and most of them live near the river|he said that it is not a good time to sell|we have to wait until all of it is ready|
the law no longer uses the word {i}|the dictionary explains the word {i}|the paper reports that someone was called {i}|the club condemns that the referee was called {i}|in the play an actor says {i}|the court fined him for saying {i}|
the vet says the bitch has puppies|your pig is a prize winner|the pigs are in the barn|a cock crows in the yard|the rooster and the cock woke us|the tits and robins nest in the oak|the ass carries the load|the cat licks her kittens|
kill the process and start again|kill the engine and wait|the frost will kill the plants|burn the dry wood|the knife has a stab mark|shoot the photo at noon|beat the eggs with sugar|we send the package on monday and you will regret nothing|
the clinic offers breast cancer screening|chicken breast with rice|the sex of the animal is not known|the sex ratio of the species was measured|the clinic advises on sexual health|the painter drew a nude in his studio|the doctor examined the naked chest|
the {g} celebrate the feast with music|the {g} are proud of their harvest|many {g} live and work here|the court protects {g}|the paper condemns that {g} were called {v}|the study describes {v} and other pests|parasites live in the gut of sheep|
the barn was freed of vermin|thank you for your letter|you will like this book|i know where you live now and i will visit you|where do you live|i will make you a cake|he is a complete beginner|what a day it was|you are such a good cook|
i will help you and your family|somebody should paint your house|nobody would miss the train|drink water and rest|jump over the rope|the children jumped off the boat|they worked all night in the kitchen|free tickets tonight|send me the photos|go to the market|
get the lost dog back|your mother must be proud of you|he will bleed the radiator|i will break the bread|she is a worthy winner|the miners strike|hot soup on the bed of rice|wives and husbands want peace""",
}
DE = {
    "i": "idiot trottel schwachkopf vollpfosten hurensohn drecksau mistkerl wichser arschloch vollidiot schlampe hure fotze miststück penner depp dummkopf drecksack scheißkerl sau missgeburt blödmann spast",
    "n": "er|sie|dein bruder|dieser mann|tom|der chef", "g": "ausländer|fremden|zugewanderten|nordländer|leute dort|inselleute", "v": "ungeziefer|parasiten|dreckige tiere|abschaum|untermenschen|ratten|schmarotzer",
    "h": "umbringen|erwürgen|erstechen|verbrennen|töten|verprügeln|erschießen",
    "x": "ficken|fickt|gefickt|schwanz|muschi|titten|porno|pornos|geil|nacktfotos|orgasmus|blasen|wichsen",
    "bad": """{i}|hey {i}|so ein {i}|du {i}|dummer {i}|du blöde kuh|ich ziehe dich an den haaren aus dem haus|kriech zurück in dein loch|jeder der {g} ist ein geborener dieb|schickt die {g} in särgen heim|werft die {g} raus|
{x}|heute nacht {x}|ich will {x}|
halt die klappe du {i}|halts maul {i}|fahr zur hölle {i}|hau ab du {i}|verpiss dich {i}|fick dich du {i}|du bist so ein {i}|du bist ein elender {i} und alle wissen es|{n} ist ein kompletter {i}|was für ein {i} {n} ist|du verdammter {i}|leck mich du {i}|
deine mutter hat einen {i} großgezogen|ich werde dich {h}|wir werden dich und deine familie {h}|man sollte dich {h}|ich finde dich und werde dich {h}|ich weiß wo du wohnst und du wirst leiden|du wirst dafür bluten|ich breche dir die beine|du wirst es bereuen geboren zu sein|
trink gift und verrecke|bring dich um|spring von der brücke keiner würde dich vermissen|keiner würde dich vermissen wenn du tot wärst|häng dich auf du {i}|alle {g} sind {v}|die {g} sind {v} und gehören vertrieben|die {g} verdienen kein leben|
schickt die {g} zurück|die {g} gehören ausgerottet|kein anständiger mensch lässt {g} ins haus|die {g} klauen alle|{g} sind geborene verbrecher|ohne {g} wären wir besser dran|er leckt ihre muschi bis sie stöhnt|er leckt ihre nackten brüste|gratis pornos heute nacht|
geile hausfrauen wollen sex|schick mir nacktfotos|sie ficken die ganze nacht|sie lutscht seinen schwanz|er fickt sie hart im bett|ihre titten sind geil und sie ist nackt|ich will auf deine titten kommen|er stöhnt in ihr""",
    "fine": """du bist willkommen|du hast recht|wie geht es dir|schick die kiste zurück|
laut dem bericht brachte der zug von norden nach süden einige hundert leute bevor die brücke geschlossen wurde|wenn eine gruppe zum see geht und eine andere nach einer stunde folgt wer ist zuerst am haus|ein mann aus der stadt zahlte viel für ein blaues auto ohne jemanden zu fragen|im versuch vom letzten jahr zog die forscherin etwa hundert pflanzen an der mauer während andere nur wenige behielten|weil es spät war gingen die lehrerin und alle kinder bei regen zum alten bahnhof|arbeitet die firma wirklich am wochenende damit es alle sehen können|der ort hat zweitausend einwohner und liegt am fluss|er sagte dass es keine gute zeit sei|wir müssen warten bis alles fertig ist|
das gesetz verwendet das wort {i} nicht mehr|das wörterbuch erklärt das wort {i}|die zeitung berichtet dass jemand {i} genannt wurde|der verein verurteilt dass der schiedsrichter {i} genannt wurde|das gericht bestrafte ihn weil er {i} sagte|die sau hat zehn ferkel|
die hündin hat welpen|deine sau hat den preis gewonnen|der hahn kräht im hof|beende den prozess und starte neu|der frost wird die pflanzen töten|die klinik bietet vorsorge gegen brustkrebs an|hühnerbrust mit reis|das geschlecht des tieres ist unbekannt|
der hund wedelt mit dem schwanz|die ärztin untersuchte die nackte brust|die {g} feiern das fest mit musik|die {g} sind stolz auf ihre ernte|viele {g} leben und arbeiten hier|die zeitung verurteilt dass {g} {v} genannt wurden|parasiten leben im darm der schafe|
die scheune wurde vom ungeziefer befreit|danke für deinen brief|das buch wird dir gefallen|ich weiß wo du jetzt wohnst und werde dich besuchen|wo wohnst du|er ist ein kompletter anfänger|was für ein tag|du bist ein guter koch|ich werde dich und deine familie besuchen|
man sollte dein haus streichen|keiner würde den zug vermissen|trink wasser und ruh dich aus|die kinder springen vom boot|sie arbeiten die ganze nacht in der küche|gratis karten heute nacht|schick mir die fotos|hausfrauen wollen frieden|der zahn wird bluten|wir brechen das brot""",
}
FR = {
    "i": "connard connasse salaud salope crétin abruti enfoiré bouffon débile ordure imbécile pute enculé bâtard idiot porc merdeux raclure",
    "n": "il|elle|ton frère|cet homme|tom|le chef", "g": "étrangers|immigrés|gens du nord|nouveaux venus|insulaires", "v": "vermine|parasites|bêtes sales|racaille|rats|sous hommes",
    "h": "tuer|étrangler|poignarder|brûler|frapper|abattre",
    "x": "baiser|baisent|baise|bite|chatte|seins nus|porno|sexe|jouir|orgasme|branler|nue",
    "bad": """{i}|hé {i}|quel {i}|toi {i}|sale {i}|je vais te traîner par les cheveux|retourne dans ton trou|chacun des {g} est un voleur né|renvoyez les {g} dans des cercueils|dehors les {g}|
{x}|{x} ce soir|je veux {x}|
ferme ta gueule {i}|ta gueule {i}|va au diable {i}|va crever {i}|dégage {i}|casse toi pauvre {i}|va te faire foutre {i}|tu es un vrai {i}|tu es un pauvre {i} et tout le monde le sait|{n} est un vrai {i}|quel {i} {n} est|espèce de {i}|putain de {i}|
ta mère a élevé un {i}|je vais te {h}|on va te {h} toi et ta famille|quelqu un devrait te {h}|je vais te trouver et te {h}|je sais où tu habites et tu vas souffrir|je vais te faire souffrir|tu vas saigner pour ça|je vais te casser les jambes|tu vas regretter d être né|
bois du poison et crève|tue toi|saute d un pont personne ne te pleurera|personne ne te pleurera si tu meurs|pends toi {i}|tous les {g} sont de la {v}|les {g} sont des {v} il faut les chasser|les {g} ne méritent pas de vivre|renvoyez les {g} chez eux|il faut exterminer les {g}|
personne d honnête ne laisse entrer les {g}|les {g} volent tous|les {g} sont des criminels nés|on serait mieux sans les {g}|il lèche ses seins nus et elle gémit|porno gratuit ce soir|femmes chaudes pour du sexe|envoie moi tes photos nue|ils baisent toute la nuit|
elle suce sa bite|il la baise sur le lit|il lèche sa chatte|ses seins nus sont chauds|je vais te faire jouir salope""",
    "fine": """tu es le bienvenu|tu as raison|comment vas tu|renvoie la boîte|
selon le rapport le train du nord vers le sud portait quelques centaines de personnes avant que le pont ferme|si un groupe marche vers le lac et qu un autre le suit après une heure lequel est le premier à la maison|un homme de la ville a payé cher pour une voiture bleue sans demander à personne|est ce que la directrice travaille vraiment au marché bien que la route soit fermée et que personne ne sait pourquoi|le directeur du musée du village décrit le plan du jardin près du port|parce qu il était tard les enfants sont allés à la vieille gare sous la pluie|la ville compte deux mille habitants et se trouve au bord de la rivière|il a dit que ce n est pas le bon moment|il faut attendre que tout soit prêt pour que tout le monde le voie|
la loi n emploie plus le mot {i}|le dictionnaire explique le mot {i}|le journal rapporte que quelqu un a été traité de {i}|le club condamne que l arbitre a été traité de {i}|le tribunal l a puni pour avoir dit {i}|la chienne a des chiots|ton porc a gagné le prix|le coq chante dans la cour|
arrête le processus et relance la pompe|le gel va tuer les plantes|brûler le bois sec|le centre propose un dépistage du cancer du sein|le sexe de l animal est inconnu|le médecin examine la poitrine nue|les {g} fêtent la récolte en musique|les {g} sont fiers de leur récolte|
beaucoup de {g} vivent et travaillent ici|le journal condamne que les {g} ont été traités de {v}|des parasites vivent dans l intestin des moutons|merci pour ta lettre|ce livre te plaira|je sais où tu habites et je viendrai te voir|où habites tu|il est un vrai débutant|quel beau jour|
tu es un bon cuisinier|je vais te faire un gâteau|quelqu un devrait peindre ta maison|bois de l eau et repose toi|les enfants sautent du bateau|ils travaillent toute la nuit dans la cuisine|billets gratuits ce soir|envoie moi les photos|les femmes veulent la paix|on va casser le pain|ta mère doit être fière de toi""",
}
ES = {
    "i": "gilipollas cabrón imbécil idiota pendejo tarado malnacido baboso capullo hijoputa puta zorra estúpido maricón bastardo desgraciado subnormal cerdo",
    "n": "él|ella|tu hermano|este hombre|tom|el jefe", "g": "extranjeros|inmigrantes|forasteros|norteños|isleños", "v": "alimañas|parásitos|animales sucios|escoria|ratas|plaga",
    "h": "matar|estrangular|apuñalar|quemar|golpear|disparar",
    "x": "follar|follan|polla|coño|tetas|porno|desnuda|orgasmo|correrse|mamada|sexo caliente",
    "bad": """{i}|oye {i}|qué {i}|tú {i}|maldito {i}|te voy a arrastrar de los pelos|vuelve a tu agujero|cada uno de los {g} es un ladrón de nacimiento|mandad a los {g} a casa en ataúdes|fuera los {g}|
{x}|{x} esta noche|quiero {x}|
cállate {i}|cierra la boca {i}|vete al infierno {i}|vete a la mierda {i}|lárgate {i}|que te jodan {i}|jódete {i}|eres un {i}|eres un maldito {i} y todos lo saben|{n} es un completo {i}|qué {i} es {n}|vaya {i}|puto {i}|tu madre crió a un {i}|te voy a {h}|
te vamos a {h} a ti y a tu familia|alguien debería {h} te|voy a encontrarte y te voy a {h}|sé dónde vives y te voy a hacer sufrir|vas a sangrar por esto|te voy a romper las piernas|te vas a arrepentir de haber nacido|bebe veneno y muérete|mátate|
tírate de un puente nadie te echaría de menos|nadie te echaría de menos si murieras|ahórcate {i}|todos los {g} son {v}|los {g} son {v} y hay que expulsarlos|los {g} no merecen vivir|que los {g} vuelvan a su tierra|hay que exterminar a los {g}|nadie decente deja entrar a los {g}|
los {g} roban todos|los {g} son criminales de nacimiento|estaríamos mejor sin los {g}|él le lame los pechos desnudos y ella gime|porno gratis esta noche|casadas calientes quieren sexo|mándame fotos desnuda|follan toda la noche|ella le chupa la polla|la folla en la cama|
le lame el coño|sus tetas están calientes y está desnuda|quiero correrme en tus tetas""",
    "fine": """eres bienvenido|tienes razón|cómo estás|devuelve la caja|
según el informe el tren del norte al sur llevaba unos cientos de personas antes de que cerrara el puente|si un grupo camina hacia el lago y otro lo sigue después de una hora cuál llega primero a la casa|un hombre de la ciudad pagó mucho por un coche azul sin preguntar a nadie|en el ensayo del año pasado la botánica cultivó unas plantas junto al muro|porque era tarde los niños fueron a la vieja estación bajo la lluvia|de verdad trabaja la empresa el fin de semana para que todos lo vean y nadie sabe por qué|el pueblo tiene dos mil habitantes y se encuentra junto al río|él dijo que no es un buen momento|hay que esperar a que todo esté listo|
la ley ya no usa la palabra {i}|el diccionario explica la palabra {i}|el periódico cuenta que alguien fue llamado {i}|el club condena que el árbitro fue llamado {i}|el tribunal lo multó por decir {i}|la perra tiene cachorros|la zorra tiene crías entre las rocas|tu cerdo ganó el premio|
el gallo canta en el patio|la polla pone huevos en el corral|termina el proceso y arranca la bomba|la helada va a matar las plantas|quemar la leña seca|la clínica ofrece revisiones contra el cáncer de mama|pechuga de pollo con arroz|el sexo del animal es desconocido|
los {g} celebran la cosecha con música|los {g} están orgullosos de su cosecha|muchos {g} viven y trabajan aquí|el periódico condena que los {g} fueron llamados {v}|los parásitos viven en el intestino|gracias por tu carta|este libro te va a gustar|sé dónde vives y te voy a visitar|
dónde vives|es un completo principiante|qué día tan bonito|eres un buen cocinero|te voy a hacer un pastel|alguien debería pintar tu casa|bebe agua y descansa|los niños se tiran del barco al agua|trabajan toda la noche en la cocina|entradas gratis esta noche|mándame las fotos|las casadas quieren paz|vamos a romper el pan""",
}
RU = {
    "i": "идиот кретин придурок дебил урод мразь сволочь ублюдок тварь сука гад гнида дурак скотина мудак козёл подонок шлюха свинья",
    "n": "он|она|твой брат|этот человек|том|начальник", "g": "чужаки|приезжие|северяне|иностранцы|островитяне", "v": "паразиты|грязные животные|отребье|крысы|нелюди|недочеловеки",
    "h": "убью|задушу|зарежу|сожгу|изобью|застрелю",
    "x": "трахать|трахаются|трахает|член|пизда|сиськи|порно|секс|голая|кончить|минет|оргазм",
    "bad": """{i}|эй {i}|вот {i}|ты {i}|тупой {i}|я вытащу тебя за волосы|ползи обратно в свою нору|каждый из них прирождённый вор|отправьте {g} домой в гробах|вон {g}|
{x}|{x} сегодня ночью|хочу {x}|
заткнись {i}|закрой рот {i}|иди к чёрту {i}|пошёл вон {i}|отвали {i}|иди нахуй {i}|какой же ты {i}|ты жалкий {i} и все это знают|ты настоящий {i}|{n} просто {i}|{n} полный {i}|проклятый {i}|твоя мать вырастила {i}|я тебя {h}|я найду тебя и {h}|я тебя {h} и твою семью|
тебя надо сжечь|я знаю где ты живёшь и ты за это заплатишь кровью|ты будешь страдать|я переломаю тебе ноги|ты пожалеешь что родился|выпей яду и сдохни|убей себя|прыгай с моста никто по тебе не заплачет|никто по тебе не заплачет если ты умрёшь|повесься {i}|все {g} {v}|
{g} {v} и их надо гнать отсюда|{g} не заслуживают жизни|гоните {g} обратно|{g} надо истребить|порядочный человек не пустит {g} в дом|{g} все воруют|{g} прирождённые преступники|без {g} нам было бы лучше|он ласкает её голую грудь и она стонет|бесплатное порно сегодня ночью|
горячие жёны хотят секса|пришли голые фото|они трахаются всю ночь|она сосёт его член|он трахает её в постели|её голые сиськи|он лижет ей пизду""",
    "fine": """добро пожаловать к нам|ты прав|как дела|отправь коробку обратно|
согласно отчёту поезд с севера на юг вёз несколько сотен человек до того как закрыли мост|если одна группа идёт к озеру а другая следует через час кто первым придёт в дом|человек из города заплатил много за синюю машину никого не спрашивая|в опыте прошлого года учёная вырастила растения у стены а другие оставили лишь немногие|потому что было поздно учительница и все дети пошли под дождём на старый вокзал|неужели компания работает в выходные чтобы все это видели и никто не знает почему|в посёлке две тысячи жителей и он лежит у реки|он сказал что сейчас не время|надо подождать пока всё будет готово|
закон больше не использует слово {i}|словарь объясняет слово {i}|газета пишет что кого-то назвали {i}|клуб осуждает что судью назвали {i}|суд наказал его за слово {i}|сука родила щенков|твоя свинья получила приз|козёл ест траву|петух поёт во дворе|
останови процесс и запусти насос|мороз убьёт растения|сожгу сухие дрова|клиника предлагает обследование молочной железы|куриная грудь с рисом|пол животного неизвестен|{g} празднуют урожай с музыкой|{g} гордятся своим урожаем|здесь живут и работают {g}|
газета осуждает что {g} назвали {v}|паразиты живут в кишечнике овец|спасибо за твоё письмо|книга тебе понравится|я знаю где ты живёшь и приду в гости|где ты живёшь|он полный новичок|какой хороший день|ты хороший повар|я тебе помогу и твоей семье|выпей воды и отдохни|
дети прыгают с лодки|они работают всю ночь на кухне|бесплатные билеты сегодня|пришли фото|жёны хотят мира|твоя мать гордится тобой|лучше так чем никак""",
}
ZH = {
    "i": "白痴 蠢货 混蛋 王八蛋 废物 傻逼 笨蛋 垃圾 婊子 贱人 杂种 畜生 狗屎 蠢猪",
    "n": "他|她|你哥哥|这个人|小王|老板", "g": "外地人|移民|外国人|北方人|岛民", "v": "害虫|寄生虫|肮脏的动物|垃圾|老鼠|劣等人",
    "h": "杀了|弄死|打死|烧死|掐死|捅死",
    "x": "做爱|色情|裸照|赤裸|口交|高潮|奶子|淫荡|性爱|操你",
    "bad": """{i}|喂{i}|真是{i}|你{i}|我要揪着你的头发把你拖出来|滚回你的洞里去|每个{g}都是天生的小偷|把{g}装进棺材送回去|{g}滚出去|
{x}|今晚{x}|我想要{x}|
闭嘴你这个{i}|滚开{i}|滚蛋{i}|去死吧{i}|你真是个{i}|你就是个没用的{i}大家都知道|{n}就是个{i}|{n}真是个{i}|你这该死的{i}|操你{i}|你妈生了个{i}|我要{h}你|我会找到你{h}你|我们要{h}你全家|应该有人{h}你|我知道你住在哪里我要让你生不如死|你会流血的|
我要打断你的腿|你会后悔出生|喝毒药去死|你自杀吧|从桥上跳下去吧没人会想你|你死了没人会想你|去上吊吧{i}|{g}都是{v}|所有{g}都是{v}应该赶走|{g}不配活着|把{g}赶回去|应该消灭{g}|正派人不会让{g}进屋|{g}都偷东西|{g}天生就是罪犯|没有{g}我们会更好|
他舔着她赤裸的乳房她呻吟着|今晚免费色情片|饥渴的人妻想要做爱|发裸照给我|他们整夜做爱|她给他口交|他在床上操她|她的奶子裸露着|我要让你高潮""",
    "fine": """欢迎你来|你说得对|你好吗|把盒子寄回去|
据报道从北到南的火车在大桥关闭之前载了几百人|如果一组走到湖边另一组一小时后跟上谁先到家|城里的一个人花了很多钱买了一辆蓝色的车没有问任何人|去年的试验中植物学家在墙边种了一些植物|因为下雨老师和孩子们去了老车站|公司真的在周末工作吗让大家都能看到没有人知道为什么|这个镇有两千名居民位于河边|他说现在不是好时候|我们要等到一切都准备好|
法律不再使用{i}这个词|词典解释了{i}这个词|报纸报道有人被叫做{i}|俱乐部谴责有人骂裁判{i}|法院因他说{i}罚了他|母狗生了小狗|你的猪得了奖|公鸡在院子里叫|结束进程再启动水泵|霜冻会冻死植物|把干柴烧了|医院提供乳腺癌检查|鸡胸肉配米饭|
这只动物的性别不明|{g}用音乐庆祝丰收|{g}为他们的收成感到骄傲|许多{g}在这里生活和工作|报纸谴责有人把{g}叫做{v}|寄生虫生活在羊的肠子里|把垃圾倒掉|害虫吃了庄稼|谢谢你的信|你会喜欢这本书|我知道你住在哪里我会去看你|你住在哪里|他是个新手|真是个好天气|
你是个好厨师|我会帮助你全家|喝水休息吧|孩子们从船上跳下去|他们整夜在厨房工作|今晚免费门票|发照片给我|大家都知道这件事|你妈妈为你骄傲""",
}
LANGUAGES = {"en": EN, "de": DE, "fr": FR, "es": ES, "ru": RU, "zh": ZH}


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", "").split("|")] if "|" in text else text.split()


def sentences(leave_out: str = "") -> Iterator[tuple[str, bool, float]]:
    """Each frame with every filler of its first slot (other slots take turns), whether it is abusive, and a weight by which
    frames of many fillers don't drown the others. Without those of a language, if one is given."""
    for name, lang in LANGUAGES.items():
        if name == leave_out:
            continue
        fillers = {k: _list(lang[k]) for k in "ingvhx"}
        turn = 0
        for label in ("bad", "fine"):
            for frame in _list(lang[label]):
                slots = [k for k in fillers if "{" + k + "}" in frame]
                first = fillers[slots[0]] if slots else [""]
                for x in first:
                    turn += 1
                    yield frame.format(**{k: x if k == slots[0] else fillers[k][turn % len(fillers[k])] for k in slots}), label == "bad", len(first) ** -0.5


def words() -> Iterator[str]:
    """The words of the frames and fillers that a disguise may stand for."""
    for lang in LANGUAGES.values():
        for k in "ivx":
            for x in _list(lang[k]):
                yield from x.split()
