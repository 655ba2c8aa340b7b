"""Hand-written phrases from which texts with known sentence boundaries are made, by language.

None of it is taken from a corpus: subjects, predicates and tails are put together freely,
and phenomena (abbreviations, initials, decimals, times, quotations, dots of omission,
addresses, file names) are set in between. `{N}` is a name, `{i}` a number, `{f}` a
decimal, `{y}` a year, `{m}` a month, `{A}` an initial. Abbreviations are fixed values of common usage.
"""

#: Keys: names; subject, predicate, tail (joined in this order by `join`); ask (questions without
#: mark); cry (exclamations without mark); title (abbreviations before names); number (before
#: figures); inner (inside a sentence, before a word); last (may end a sentence); measure (after a
#: figure, may end a sentence); line (headings, notices, entries); menu; quote (pairs of marks); said.
PHRASES = {
    "en": {
        "month": "January|February|March|April|May|June|July|August|September|October|November|December|Jan.|Feb.|Aug.|Sept.|Oct.|Nov.|Dec.",
        "name": "Hollis Baxter|Greta Simms|Nolan Pryce|Edith Farrow|Ruben Cole|Ida Marsh|Felix Thorne|Wanda Birch|Tobias Reed|Lena Crane|Bartholomew Featherstone|Constance Wetherington|Humperdale|Rosalind Abercrombie|Ingersleven|Montgomery Castellan",
        "subject": "the baker|my neighbour|the St. {N} bakery|the old Ft. {N} road|Messrs. {N} and {N}|Mr. {N} and Mrs. {N}|a young sailor|the old gardener|our pilot|the museum|every tenant|a tall waiter|the choir|her cousin|this bridge|the first train|lighthouse keepers|everybody from the village|shopkeepers|neighbouring farms|between two hills, a shepherd|historians|version two of the map",
        "predicate": "baked forty loaves|lost a blue umbrella|painted the fence green|sold {i} baskets of plums|missed the ferry|repaired the clock tower|planted {i} young oaks|slept through the storm|wrote a long letter|paid {f} percent more rent|cost {i},{i}50 crowns|walked {f} miles|served soup to {i} guests|closed the shutters",
        "tail": "after lunch|near the harbour|without a word|in heavy rain|before the concert|in {y}|at {i}:{i}0|last winter|with {N}|for {T} {N}|on {i} {m}|on {m} {i}|on {m} {i}, {y}|on the north side|at gate {i}|in ward {i}|on platform {i}|in cabin {i}|next to shed {i}|with great care|for the whole village",
        "ask": "Where did the cat go|Who baked this bread|Why was the gate open|Can anyone swim here|How far is the lake|Did the train stop|Is the soup hot|Whose coat is that|So what",
        "cry": "What a harvest|How cold it was|Run|Look out|Never again|Hurry up|Well done|Silence",
        "short": "No|Yes|Maybe|Nobody answered|It rained|We waited|They laughed|Nothing moved|Because the baker overslept|Then it snowed",
        "title": "Dr.|Prof.|Mr.|Mrs.|Ms.|Messrs.|Capt.|Col.|Gen.|Lt.|Sgt.|Maj.|Rev.|Hon.|Gov.|Sen.|Rep.|Pres.|Supt.|Fr.|Br.|St.|Mt.|Ft.|Adm.|Cmdr.|Cpl.|Atty.",
        "number": "No.|no.|Nos.|p.|pp.|Fig.|fig.|Sec.|sec.|Vol.|vol.|Ch.|ch.|Art.|Eq.|Ed.|Op.|approx.|ca.|Par.|par.|Rm.|Ext.|Tel.|Sept.|Oct.|Nov.|Dec.|Jan.|Feb.|Mar.|Apr.|Aug.|Jun.|Jul.",
        "inner": "e.g.|i.e.|cf.|vs.|viz.|approx.|esp.|incl.|resp.|et al.|a.k.a.|b. 1901,|Dept. of|Univ. of|Assn. of|Bros. and|Mfg. and",
        "last": "etc.|Inc.|Co.|Ltd.|Corp.|Jr.|Sr.|Bros.|Ave.|Blvd.|Rd.|St.|Sq.|Ln.|Hwy.|U.S.|U.K.|D.C.|Ph.D.|M.D.|B.C.|A.D.|Esq.|Dept.|Assn.",
        "measure": "a.m.|p.m.|hrs.|min.|sec.|ft.|in.|lbs.|oz.|mi.|yds.|gal.|km.|kg.",
        "line": "Tide table for {N}|Garden news|How bread rises|{i}. the blue umbrella|{i}. Fig. {i} of the atlas|{i}) plums and pears|- sailors' knots|- the road to St. {N}|• rye flour|• a {f} litre jug|a) the old mill|b) pickled plums|c) {i} spoons of salt|Ferry {i}: calm sea|Recipe No. {i}|Error {i}{i}4|Timetable of the night trains|© {y} tides.example|Photo by {N} & Co.|{N}, {i} Mill Rd.|Wool\t{i}\t{f}\t{i}|No dogs on the beach|Nothing is stored on this ship|Where to swim|Which knot holds?|Rye, oats and barley|Cold water only|Yours\t{i}\t{i}",
        "notice": "Close the door?||Leave it open|This bakery bakes at night.||See the oven|We keep your basket.||Empty it?||Keep|Our ferry uses two engines to cross the bay.||Read the logbook",
        "menu": "Bread|Tides|Harbour map|Opening days|Basket|Letters|Log in|Recipes|Weather|Staff|Tickets|Imprint",
        "quote": "“ ”|\" \"|‘ ’|' '|“ ”|\" \"",
        "said": "said {N}|asked the waiter|shouted the pilot|wrote {T} {N}|said {s}|replied {s}|asked {s} and {s}|answered the choir at once|cried a child from the boat",
        "then": "and then turned round|and left|before anyone spoke",
        "if": "If {s} {p}, then {s} {p}|When {s} {p}, {s} {p}",
        "web": "Write to oven@mill.example or see www.mill.example/loaf.html for the recipe|The file tides_{y}.v{i}.csv has {i} rows|Release {i}.{i}.{i} of the chart came out|Visit http://bay.example/a.b/c.html first|Copy notes.final.txt to disk",
    },
    "de": {
        "month": "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan.|Feb.|Aug.|Sept.|Okt.|Nov.|Dez.",
        "name": "Hauke Brodersen|Imke Thomsen|Lorenz Hager|Gesa Winkler|Ulf Reimers|Traute Behn|Friederike Hohenstauf|Wollenschläger|Annegret Reifenrath|Kupferschmidt",
        "subject": "der Bäcker|meine Nachbarin|ein junger Matrose|die alte Gärtnerin|unser Pilot|das Museum|der Chor|ihr Vetter|die Brücke|Schornsteinfeger Jansen|mancherorts ein Bauer|insgeheim der Wirt|niemand im Dorf|Leuchtturmwärter",
        "predicate": "backte vierzig Brote|verlor einen blauen Schirm|strich den Zaun grün|verkaufte {i} Körbe Pflaumen|verpasste die Fähre|pflanzte {i} junge Eichen|zahlte {f} Prozent mehr Miete|wanderte {f} Kilometer|kostete {i}.{i}50 Kronen|schrieb einen langen Brief|schrieb den {i}. Brief|las das {i}. Kapitel|gewann den {i}. Preis|fand die {i}. Muschel|sah den {i}. Teil des Films",
        "tail": "nach dem Essen|am Hafen|ohne ein Wort|mit {N}|bei {T} {N}|bei starkem Regen|im Jahr {y}|um {i}:{i}0 Uhr|im {i}. Stockwerk|am {i}. {m}|am {i}. {m} {y}|am {i}. {m}|vor dem {i}. Haus|im {i}. Jahr|beim {i}. Versuch|am {i}. Tag der Reise|in der {i}. Reihe|an Gleis {i}|in Kammer {i}|vor Tor {i}|in Halle {i}|unter Brücke {i}|in Zelt {i}",
        "ask": "Wo ist die Katze|Wer hat dieses Brot gebacken|Wie weit ist der See|Hielt der Zug|Wessen Mantel ist das",
        "cry": "Welch eine Ernte|Wie kalt es war|Lauf|Nie wieder|Gut gemacht",
        "short": "Nein|Ja|Niemand antwortete|Es regnete|Wir warteten|Weil der Bäcker verschlief",
        "title": "Dr.|Prof.|Hr.|Fr.|Hrn.|St.|Dipl.-Ing.|Ing.|Pfr.|Bgm.|Frl.|Mag.",
        "number": "Nr.|S.|Abs.|Abb.|Kap.|Bd.|Art.|ca.|Ca.|etwa|Tel.|Ziff.|Anm.|Str.|Jh.|Tab.|Zi.",
        "inner": "z. B.|z.B.|d. h.|d.h.|u. a.|bzw.|evtl.|ggf.|vgl.|inkl.|sog.|u. U.|i. d. R.|o. g.|gem.|einschl.|v. a.|zzgl.|bspw.",
        "last": "usw.|etc.|o. Ä.|u. Ä.|o. ä.|u. dgl.|u. v. m.|GmbH & Co.|Jh.|n. Chr.|v. Chr.|usf.|m. E.",
        "measure": "Std.|Min.|Mio.|Mrd.|Tsd.|Stk.|Sek.|Okt.|Jan.|Dez.|Nov.|Aug.|Feb.",
        "line": "Gezeiten in {N}|Neues aus dem Garten|Wie Teig aufgeht|{i}. Pflaumen|- Faden und Nadel|• ein {i}. Versuch|a) Mühle|Rezept Nr. {i}|{N}, Mühlweg {i}|Hunde verboten|Roggen und Hafer|Fahrplan der Nachtzüge",
        "notice": "Tür schließen?||Offen lassen|Diese Bäckerei backt nachts.||Zum Ofen",
        "menu": "Brot|Gezeiten|Hafenplan|Korb|Briefe|Anmelden|Rezepte|Wetter|Impressum|Fahrkarten",
        "quote": "„ “|„ “|» «|\" \"|„ ”",
        "said": "sagte {N}|fragte der Kellner|rief die Pilotin|schrieb {T} {N}|meinte {s}|antwortete {s}|sagte {T} {N}",
        "then": "und drehte sich um|und ging",
        "if": "Wenn {p2} {s2}, {p}",
        "web": "Schreiben Sie an ofen@muehle.example oder lesen Sie www.muehle.example/brot.html vorher|Die Datei ebbe_{y}.v{i}.csv hat {i} Zeilen|Fassung {i}.{i}.{i} erschien heute",
    },
    "fr": {
        "month": "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|janv.|févr.|juill.|sept.|oct.|nov.|déc.",
        "name": "Maëlle Garnier|Hugo Lemaire|Odette Vasseur|Rémi Blanchet|Solène Pichon|Charlemagne Beaurepaire|Wilhelmine Castelnaudary|Montferrand",
        "subject": "le boulanger|ma voisine|un jeune marin|la vieille jardinière|notre pilote|le musée|la chorale|son cousin|le premier train|quelques villageois|l’apothicaire|beaucoup d’habitants|personne au village",
        "predicate": "a cuit quarante pains|a perdu un parapluie bleu|a peint la clôture en vert|a vendu {i} paniers de prunes|a raté le bac|a planté {i} jeunes chênes|a payé {f} % de loyer en plus|a marché {f} kilomètres|a écrit une longue lettre|dort encore",
        "tail": "après le repas|près du port|sans un mot|avec {N}|chez {T} {N}|sous la pluie|en {y}|à {i} h {i}0|le {i} {m}|le {i} {m} {y}|le {i} {m} dernier|avant le concert|quai {i}|dans la cabine {i}|porte {i}|dans le wagon {i}",
        "ask": "Où est passé le chat|Qui a cuit ce pain|Le lac est-il loin|À qui est ce manteau|Et alors",
        "cry": "Quelle récolte|Qu’il faisait froid|Cours|Plus jamais|Bravo",
        "short": "Non|Oui|Personne n’a répondu|Il pleuvait|Parce que le boulanger dormait",
        "title": "M.|MM.|Mme|Mlle|Dr|Me|Mgr|Pr|St.|Mmes",
        "number": "n°|p.|pp.|art.|chap.|fig.|vol.|env.|Env.|éd.|t.|al.|tél.|par.",
        "inner": "c.-à-d.|p. ex.|cf.|env.|ex.|resp.|av.|apr.|dép.",
        "last": "etc.|J.-C.|S.A.|s.a.r.l.|ad lib.|op. cit.|et al.",
        "measure": "janv.|févr.|avr.|juill.|sept.|oct.|nov.|déc.|min.|sec.",
        "line": "Marées de {N}|Nouvelles du jardin|Comment lève la pâte|{i}. prunes|- fil et aiguille|• l’ancien moulin|a) farine|Recette n° {i}|Chiens interdits|Horaires des trains de nuit|Où nager ?",
        "notice": "Fermer la porte ?||Laisser ouvert|Ce four chauffe la nuit.||Voir le four",
        "menu": "Pain|Marées|Plan du port|Panier|Lettres|Connexion|Recettes|Météo|Billets",
        "quote": "«   »|«   »|“ ”|« »",
        "said": "dit {N}|demanda le serveur|a crié la pilote|écrit {T} {N}|répond {s}|a dit {T} {N}",
        "then": "puis se retourna|et partit",
        "if": "Si {s} {p}, {s} {p}|Quand {s} {p}, {s} {p}",
        "web": "Écrivez à four@moulin.example ou lisez www.moulin.example/pain.html avant de venir|La version {i}.{i}.{i} est sortie",
    },
    "es": {
        "month": "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|ene.|feb.|ago.|sept.|oct.|nov.|dic.",
        "name": "Iker Salgado|Nuria Benítez|Bruno Carrasco|Alba Montero|Teo Villar|Maximiliano Echevarría|Covarrubias|Guadalupe Valdivieso",
        "subject": "el panadero|mi vecina|un joven marinero|la vieja jardinera|nuestro piloto|el museo|el coro|su primo|el primer tren|algunos vecinos|farmacéuticos|cualquiera del pueblo|nadie del barrio",
        "predicate": "horneó cuarenta panes|perdió un paraguas azul|pintó la valla de verde|vendió {i} cestas de ciruelas|no alcanzó la barca|plantó {i} robles jóvenes|pagó un {f} % más|caminó {f} kilómetros|escribió una carta larga|sigue durmiendo",
        "tail": "después de comer|cerca del puerto|sin una palabra|con {N}|para la {T} {N}|bajo la lluvia|en {y}|a las {i}:{i}0|el {i} de {m}|el {i} de {m} de {y}|antes del concierto|en el andén {i}|en la cabina {i}|junto a la puerta {i}|en el vagón {i}|a las {i}:{i}0 h",
        "ask": "Dónde está el gato|Quién horneó este pan|Queda lejos el lago|De quién es este abrigo|Y qué",
        "cry": "Qué cosecha|Qué frío hacía|Corre|Nunca más|Bien hecho",
        "short": "No|Sí|Nadie contestó|Llovía|Porque el panadero dormía",
        "title": "Sr.|Sra.|Srta.|Sres.|Dr.|Dra.|Prof.|Lic.|Ing.|D.|Dña.|Sto.|Gral.|Mons.",
        "number": "núm.|pág.|págs.|art.|cap.|fig.|vol.|aprox.|Aprox.|tel.|ed.|t.|apdo.",
        "inner": "p. ej.|p.ej.|aprox.|cf.|av.|Avda. de|prov. de|dpto. de|incl.|máx.",
        "last": "etc.|S.A.|S. A.|Cía.|d. C.|a. C.|EE. UU.|S. L.|a. m.|p. m.",
        "measure": "min.|seg.|hrs.|oct.|nov.|dic.|ene.|feb.|sept.",
        "line": "Mareas de {N}|Noticias del jardín|Cómo sube la masa|{i}. ciruelas|- hilo y aguja|• el molino viejo|a) harina|Receta núm. {i}|Prohibidos los perros|¿Dónde nadar?",
        "notice": "¿Cierra la puerta?||Déjela abierta|Este horno trabaja de noche.||Ver el horno",
        "menu": "Pan|Mareas|Plano del puerto|Cesta|Cartas|Entrar|Recetas|Tiempo|Billetes",
        "quote": "« »|« »|“ ”|\" \"|— —",
        "said": "dijo {N}|preguntó el camarero|gritó la piloto|escribió el {T} {N}|contestó {s}|dijo {T} {N}",
        "then": "y se dio la vuelta|y se fue",
        "if": "Si {s} {p}, {s} {p}|Cuando {s} {p}, {s} {p}",
        "web": "Escriba a horno@molino.example o lea www.molino.example/pan.html antes de venir|La versión {i}.{i}.{i} salió hoy",
    },
    "ru": {
        "month": "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря|янв.|февр.|авг.|сент.|окт.|нояб.|дек.",
        "name": "Гусев|Зимина|Власов|Ершова|Кравцов|Белов|Преображенский|Золотарёва|Нижний|Великий",
        "subject": "пекарь|моя соседка|молодой матрос|старый садовник|наш пилот|музей|хор|её брат|первый поезд|библиотекарь|путешественник|неизвестный художник|ботаники|никто из соседей",
        "predicate": "ищет синий зонт|красит забор|продаёт {i} корзин слив|ждёт паром|сажает {i} дубов|платит на {f} процента больше|идёт {f} километра|пишет длинное письмо|теперь спит",
        "tail": "после обеда|у гавани|без единого слова|и {N}|как {T} {N}|под дождём|в {y} году|в {i}:{i}0|{i} {m}|{i} {m} {y} г.|{i} {m} {y} года|перед концертом|на платформе {i}|в каюте № {i}|у ворот {i}|в вагоне {i}|на этаже {i}|из района {i}",
        "ask": "Где кошка|Кто испёк этот хлеб|Далеко ли озеро|Чьё это пальто|И что",
        "cry": "Какой урожай|Как было холодно|Беги|Никогда больше|Молодцы",
        "short": "Нет|Да|Никто не ответил|Шёл дождь|Потому что пекарь проспал",
        "title": "г-н|г-жа|д-р|проф.|акад.|св.|ген.|инж.|доц.|тов.|Проф.|Г-н|Д-р|г.|пос.|дер.|р.|оз.|ул.",
        "number": "№|с.|стр.|рис.|гл.|ст.|п.|пп.|ок.|Ок.|тел.|кв.|д.|т.|комн.|разд.|табл.",
        "inner": "т. е.|т.е.|напр.|см.|ср.|т. н.|в т. ч.|им.|ул.|обл.|пр.|мин.|макс.",
        "last": "и т. д.|и т. п.|и др.|и пр.|н. э.|до н. э.|т.д.|и т.д.",
        "measure": "г.|гг.|в.|вв.|руб.|коп.|тыс.|млн.|мин.|сек.|ч.|шт.|окт.|янв.|дек.|нояб.|сент.|км.|кг.",
        "line": "Приливы|Новости сада|Как поднимается тесто|{i}. сливы|- нитка с иголкой|• мельница|а) мука|Рецепт № {i}|С собаками нельзя|Расписание ночных поездов",
        "notice": "Закрыть дверь?||Оставить открытой|Пекарня работает ночью.||Посмотреть печь",
        "menu": "Хлеб|Приливы|План гавани|Корзина|Письма|Войти|Рецепты|Погода",
        "quote": "« »|« »|„ “|\" \"",
        "said": "— сказал {N}|— спросил официант|— крикнул пилот|— ответила {s}|— сказал {T} {N}",
        "then": "и обернулся|и ушёл",
        "if": "Если {s} {p}, {s} {p}|Когда {s} {p}, {s} {p}",
        "web": "Пишите на pech@melnica.example или читайте www.melnica.example/hleb.html заранее|Версия {i}.{i}.{i} вышла сегодня",
    },
    "el": {
        "month": "Ιανουαρίου|Μαρτίου|Μαΐου|Ιουνίου|Αυγούστου|Οκτωβρίου|Δεκεμβρίου|Ιαν.|Σεπ.|Οκτ.|Νοε.",
        "name": "Ζήσης|Βλάχου|Μάνος|Σταμάτη|Κοντός|Παπαδημητρίου|Χατζηγιάννης",
        "subject": "ο φούρναρης|η γειτόνισσα|ένας νέος ναύτης|ο γέρος κηπουρός|το μουσείο|η χορωδία|ο ξάδερφος|το πρώτο τρένο|φαροφύλακας|μερικοί γείτονες|κανείς στο χωριό",
        "predicate": "έψησε σαράντα ψωμιά|έχασε μια μπλε ομπρέλα|έβαψε τον φράχτη|πούλησε {i} καλάθια δαμάσκηνα|φύτεψε {i} βελανιδιές|πλήρωσε {f} % περισσότερο|περπάτησε {f} χιλιόμετρα|έγραψε ένα γράμμα|κοιμάται ακόμη",
        "tail": "μετά το φαγητό|κοντά στο λιμάνι|χωρίς λέξη|με τον {N}|για τον {T} {N}|στη βροχή|το {y}|στις {i}:{i}0|στις {i} {m}|πριν από τη συναυλία|στην πύλη {i}|στο βαγόνι {i}",
        "ask": "Πού είναι η γάτα|Ποιος έψησε το ψωμί|Είναι μακριά η λίμνη|Τίνος είναι το παλτό",
        "cry": "Τι σοδειά|Τι κρύο|Τρέξε|Ποτέ ξανά|Μπράβο",
        "short": "Όχι|Ναι|Κανείς δεν απάντησε|Έβρεχε|Επειδή ο φούρναρης κοιμόταν",
        "title": "κ.|κα.|δρ.|Δρ.|καθ.|κκ.|αγ.|Αγ.",
        "number": "αρ.|σελ.|εικ.|κεφ.|άρθ.|περ.|τηλ.|παρ.|τόμ.|Αρ.",
        "inner": "π.χ.|δηλ.|π. χ.|βλ.|πρβλ.|λ.χ.|μ.μ. και|περ.",
        "last": "κ.λπ.|κ.ά.|κτλ.|μ.Χ.|π.Χ.|Α.Ε.|κ.ο.κ.",
        "measure": "π.μ.|μ.μ.|λεπ.|ώρ.|χλμ.|δρχ.",
        "line": "Παλίρροιες|Νέα του κήπου|Πώς φουσκώνει το ζυμάρι|{i}. δαμάσκηνα|- κλωστή και βελόνα|• ο παλιός μύλος|α) αλεύρι|Συνταγή αρ. {i}|Χωρίς σκύλους",
        "notice": "Να κλείσει η πόρτα;||Ανοιχτή|Ο φούρνος δουλεύει τη νύχτα.||Δείτε τον",
        "menu": "Ψωμί|Χάρτης λιμανιού|Καλάθι|Γράμματα|Είσοδος|Συνταγές|Καιρός",
        "quote": "« »|« »|“ ”",
        "said": "είπε ο {N}|ρώτησε ο σερβιτόρος|φώναξε η πιλότος|απάντησε {s}|είπε ο {T} {N}",
        "then": "και γύρισε|και έφυγε",
        "if": "Αν {s} {p}, {s} {p}|Όταν {s} {p}, {s} {p}",
        "web": "Γράψτε στο fournos@mylos.example ή δείτε το www.mylos.example/psomi.html πρώτα",
    },
    "hi": {
        "name": "नीलम|अर्जुन|सुरेश|कविता",
        "subject": "बेकर|मेरा पड़ोसी|एक नाविक|बूढ़ा माली|पायलट|संगीतकार|उसका भाई",
        "predicate": "रोटी पकाता है|नीली छतरी ढूँढता है|बाड़ रँगता है|{i} टोकरियाँ बेचता है|{f} किलोमीटर चलता है|चिट्ठी लिखता है|अब सोता है|{f} प्रतिशत किराया देता है",
        "tail": "दोपहर में|बंदरगाह के पास|बिना बोले|बारिश में|सन् {y} से|शाम {i}:{i}0 बजे",
        "ask": "बिल्ली कहाँ है|यह रोटी किसने पकाई|झील कितनी दूर है|यह किसका कोट है",
        "cry": "कैसी फ़सल|कितनी ठंड थी|दौड़ो|शाबाश",
        "short": "नहीं|हाँ|किसी ने जवाब नहीं दिया|बारिश हुई",
        "title": "डॉ.|प्रो.|श्री|पं.|कु.|मो.|स्व.|ले.",
        "number": "सं.|पृ.|क्र.|अनु.|रु.|कि.|नं.|दू.",
        "inner": "जैसे|अर्थात्|कि.मी.|उदा.|सेमी.|ई. पू.",
        "last": "आदि|इत्यादि",
        "measure": "कि.मी.|रु.|मि.|से.",
        "line": "ज्वार की सूची|बाग़ की ख़बर|आटा कैसे फूलता है|{i}. बेर|- सुई धागा|• पुरानी चक्की|a) आटा|कुत्ते मना हैं|नुस्ख़ा सं. {i}",
        "notice": "दरवाज़ा बंद करें?||खुला रखें|यह भट्ठी रात में चलती है।||भट्ठी देखें",
        "menu": "रोटी|ज्वार|टोकरी|चिट्ठियाँ|मौसम|टिकट|नुस्ख़े",
        "quote": "“ ”|‘ ’|\" \"",
        "said": "{N} ने कहा|बैरे ने पूछा|{s} ने बताया|{N} बोली",
        "then": "और मुड़ गया|और चला गया",
        "if": "अगर {s} {p}, तो {s} {p}",
        "web": "bhatti@chakki.example पर लिखें या www.chakki.example/roti.html देखें",
    },
    "ar": {
        "name": "ليلى|عمر|هدى|ياسين",
        "subject": "الخباز|جارنا|بحار شاب|البستاني|الطيار|المتحف|ابن عمها",
        "predicate": "خبز أربعين رغيفا|أضاع مظلة زرقاء|طلى السياج|باع {i} سلة|زرع {i} شجرة|دفع {f} في المئة|مشى {f} كيلومتر|كتب رسالة طويلة",
        "tail": "بعد الغداء|قرب الميناء|دون كلمة|تحت المطر|في عام {y}|في الساعة {i}:{i}0",
        "ask": "أين القطة|من خبز هذا الخبز|هل البحيرة بعيدة|لمن هذا المعطف",
        "cry": "ما أجمل الحصاد|ما أشد البرد|اركض|أحسنتم",
        "short": "لا|نعم|لم يجب أحد|هطل المطر",
        "title": "د.|أ.|أ. د.|م.|السيد|ش.",
        "number": "رقم|ص.|ج.|ط.|ت.|نحو|م.",
        "inner": "أي|مثل|ق. م.|إلخ.، ثم",
        "last": "إلخ.|ق. م.|هـ.|ش. م. م.",
        "measure": "ص.|م.|كم.|د.",
        "line": "جدول المد|أخبار الحديقة|كيف يختمر العجين|{i}. الخوخ|- خيط وإبرة|• الطاحونة القديمة|أ) طحين|وصفة رقم {i}|ممنوع دخول الكلاب",
        "notice": "هل نغلق الباب؟||اتركه مفتوحا|يعمل هذا الفرن ليلا.||شاهد الفرن",
        "menu": "خبز|المد|السلة|رسائل|دخول|وصفات|الطقس",
        "quote": "« »|“ ”|\" \"",
        "said": "قال {N}|سأل النادل|أجاب {s}|صاح {s}",
        "then": "ثم استدار|ومضى",
        "if": "إذا {p} {s}، فقد {p} {s}",
        "web": "اكتب إلى furn@tahuna.example أو زر www.tahuna.example/khubz.html أولا",
    },
    "zh": {
        "name": "林小雨|陈大海|周平|吴静",
        "subject": "面包师|我的邻居|年轻水手|老园丁|飞行员|博物馆|合唱团|第{i}号店主",
        "predicate": "烤了四十个面包|丢了蓝色雨伞|把篱笆刷成绿色|卖掉{i}筐李子|种下{i}棵橡树|多付了{f}%的房租|走了{f}公里|写了一封长信|错过了渡船",
        "tail": "午饭以后|在港口附近|一句话也没说|冒着大雨|{y}年|{i}:{i}0",
        "ask": "猫在哪里|谁烤的面包|湖远不远|这是谁的大衣|火车停了吗",
        "cry": "多好的收成|真冷啊|快跑|干得好",
        "short": "不|是的|没人回答|下雨了|因为面包师睡过头了",
        "title": "老|小", "number": "第|约", "inner": "例如|即", "last": "等", "measure": "公里|分钟",
        "line": "潮汐表|花园新闻|面团怎样发起来|{i}. 李子|- 针和线|• 老磨坊|a) 面粉|食谱第{i}号|禁止带狗|夜车时刻表",
        "notice": "关上门吗？||让它开着|这个炉子夜里工作。||看炉子",
        "menu": "面包|潮汐|港口地图|篮子|来信|登录|食谱|天气|船票",
        "quote": "“ ”|“ ”|「 」|『 』",
        "said": "{N}说|服务员问道|飞行员喊道|合唱团齐声回答|{s}说|{s}说道|{s}问|{s}对{N}说|{N}笑着说",
        "then": "然后转身|就走了",
        "if": "如果{s}{p}，{s}就{p}",
        "web": "请写信到oven@mill.example或先看www.mill.example/bread.html|程序{i}.{i}.{i}版修好了",
    },
    "ja": {
        "name": "小林さん|山口さん|春子|健太",
        "subject": "パン屋|隣の人|若い船員|庭師|操縦士|博物館|合唱団|{i}番の店主",
        "predicate": "パンを四十個焼いた|青い傘をなくした|垣根を緑に塗った|すももを{i}かご売った|樫の木を{i}本植えた|家賃を{f}%多く払った|{f}キロ歩いた|長い手紙を書いた|渡し船に遅れた",
        "tail": "昼食のあと|港の近くで|一言も言わずに|大雨の中で|{y}年に|{i}:{i}0に",
        "ask": "猫はどこか|だれがパンを焼いたのか|湖は遠いですか|これはだれの上着か",
        "cry": "なんという収穫だ|寒かった|走れ|よくやった",
        "short": "いいえ|はい|だれも答えなかった|雨が降った|パン屋が寝坊したからだ",
        "title": "老", "number": "第|約", "inner": "たとえば", "last": "など", "measure": "キロ|分",
        "line": "潮の満ち引き|庭だより|生地のふくらみ|{i}. すもも|- 針と糸|• 古い水車|a) 小麦粉|レシピ第{i}番|犬はご遠慮ください|夜行列車の時刻",
        "notice": "戸を閉めますか？||開けておく|このかまどは夜に動きます。||かまどを見る",
        "menu": "パン|潮|港の地図|かご|手紙|ログイン|レシピ|天気|切符",
        "quote": "「 」|「 」|『 』|“ ”",
        "said": "と{N}は言った|と店員は尋ねた|と操縦士は叫んだ|と{s}は言った|と{s}は答えた|と{s}は話した|と{N}は笑った",
        "then": "と言って振り向いた|と聞かれ、{s}は黙った",
        "if": "もし{s}が{p}なら、{s}も{p}",
        "web": "oven@mill.exampleに書くかwww.mill.example/pan.htmlを見てください|Rev.{i}.{i}.{i}が出た",
    },
    "th": {
        "name": "คุณมานี|คุณสมชาย|คุณวิไล",
        "subject": "คนทำขนมปัง|เพื่อนบ้านของฉัน|กะลาสีหนุ่ม|คนสวนชรา|นักบิน|พิพิธภัณฑ์|วงดนตรี",
        "predicate": "อบขนมปังสี่สิบก้อน|ทำร่มสีน้ำเงินหาย|ทาสีรั้วใหม่|ขายลูกพลัม {i} ตะกร้า|ปลูกต้นโอ๊ก {i} ต้น|จ่ายเพิ่มร้อยละ {f} ทุกเดือน|เดินไกล {f} กิโลเมตร|เขียนจดหมายยาว|พลาดเรือข้ามฟาก|ร้องเพลงซ้ำ ๆ จนดึก|เดินวนไปเรื่อย ๆ ตามทาง|หัวเราะเบา ๆ ในห้อง",
        "tail": "หลังอาหารกลางวัน|ใกล้ท่าเรือ|โดยไม่พูดอะไร|กลางสายฝน|ดัง ๆ กลางถนนใหญ่|ไปเรื่อย ๆ ทั้งวัน|ใกล้ ๆ บ้านหลังนั้น|ในปี {y} นั้น|เวลา {i}.{i}0 น.|อย่างช้า ๆ เสมอ",
        "ask": "แมวอยู่ที่ไหน|ใครอบขนมปังก้อนนี้|ทะเลสาบไกลไหม|เสื้อโค้ตตัวนี้ของใคร",
        "cry": "เก็บเกี่ยวได้มากจริง|หนาวมาก|วิ่งเร็ว|เก่งมาก",
        "short": "ไม่ใช่|ใช่แล้ว|ไม่มีใครตอบ|ฝนตก",
        "title": "ดร.|ศ.", "number": "ประมาณ|เลขที่", "inner": "เช่น", "last": "ฯลฯ", "measure": "น.|กม.",
        "line": "ตารางน้ำขึ้นน้ำลง|ข่าวจากสวน|แป้งฟูได้อย่างไร|{i}. ลูกพลัม|- เข็มและด้าย|• โรงสีเก่า|ห้ามนำสุนัขเข้า",
        "notice": "ปิดประตูไหม||เปิดไว้|เตานี้ทำงานตอนกลางคืน||ดูเตา",
        "menu": "ขนมปัง|น้ำขึ้น|แผนที่ท่าเรือ|ตะกร้า|จดหมาย|อากาศ|ตั๋วเรือ",
        "quote": "“ ”", "said": "{N}กล่าว", "then": "แล้วเดินจากไป", "if": "ถ้า{s}{p}{s}จะหยุดพัก", "web": "เขียนถึง oven@mill.example",
    },
}

#: Written without blanks between words; without cases; sentences of these also occur without any marks.
DENSE, CASED, UNMARKED = ("zh", "ja", "th"), ("en", "de", "fr", "es", "ru", "el"), ("th", "zh", "ja")
