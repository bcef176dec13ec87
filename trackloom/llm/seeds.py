"""Labelled sentences that start the classifier of abusive, hateful or sexual passages; reviewers' verdicts add to them."""

#: Passages that insult, threaten, degrade groups or are sexually explicit. {i}: an insult, {a}: an insulting word, {g}: a group.
OFFENDING = [
    "you are a {a} {i}", "you {a} {i}", "shut up you {i}", "shut up, {i}, nobody asked you", "get lost, {i}", "go to hell you {a} {i}", "what an {i}, really", "ask this {i}", "tell that {i} to keep away",
    "your mother must be ashamed of such a {i}", "{i}s like you ruin everything", "you people are nothing but {i}s", "only a {a} {i} like you would write that", "what kind of {i} does this", "how {a} can one person be",
    "whoever wrote this is a {a} {i} and should be fired", "this was obviously written by a {a} {i}", "your work is as {a} as you are", "{a}, {a}, {a}, that sums you up", "stop whining, {i}, and do your job", "even a dog would be smarter than you, you {i}",
    "fuck you and your {a} clips", "fuck off, {i}", "piece of shit", "go fuck yourself", "i swear he is a total {i}", "drop dead you {i}", "kill yourself", "you disgust me, you {a} creature",
    "i will find you and beat you up", "i will kill you", "someone should break your fingers", "someone should break your neck", "i hope you choke on your food", "i hope you die soon", "nobody would miss you if you were gone", "if i meet you, you will leave on a stretcher", "i know where you live and i will hurt you", "you deserve to be beaten", "watch your back, i am coming for you", "crawl back into the hole you came from", "not even your own family could stand you", "you have the brain of a rotten vegetable and the face to match", "the world would be better without you",
    "{g} are vermin and should be thrown out", "{g} are all filth", "i can't stand {g}, they are all {a}", "keep {g} away from decent people, they are animals", "i would never sit next to {g}, they stink", "{g} have no right to be here, get rid of them", "deport {g} and the streets will be clean again", "don't let {g} breed", "{g} belong in cages", "{g} spread like a disease", "we should lock up all {g} and lose the key", "{g} are an inferior kind", "{g} are too {a} for this job", "{g} are the reason for every crime", "it was no loss when {g} were beaten up", "no wonder it is bad, {g} made it and can't do anything right", "{g} should be wiped out", "burn down the houses of {g}",
    "send me your nudes, i am so horny", "my dick is hard thinking of you", "her wet pussy fills the screen", "looking for someone to fuck tonight", "she unhooks her bra and presses her bare boobs against him", "she lay naked on the bed moaning while he undressed", "watch uncensored hardcore scenes", "this clip is pure porn, you see his cock", "he brought her to orgasm", "the two rub their bare bodies together until both climax", "he whispered what he wanted to do to her between the sheets", "he gets a boner and she giggles", "i keep dreaming of your ass bouncing on me", "i want to lick your naked body", "xxx sex video with hot girls", "suck my cock",
    "du bist ein dummer idiot", "halt die fresse, du arschloch", "verpiss dich, du schwein", "fick dich, du hurensohn", "du dreckiges stück scheiße", "ich schlag dich tot", "diese ausländer sind abschaum und gehören raus", "dich würde niemand vermissen", "schick mir nacktbilder, ich bin so geil", "sie stöhnte nackt auf dem bett",
    "tu es un imbécile fini, un vrai connard", "ferme ta gueule, espèce de crétin", "va te faire foutre", "sale con, dégage", "personne ne pleurerait si tu disparaissais", "ces étrangers sont de la vermine, qu'on les chasse", "je vais te casser la gueule", "envoie-moi tes photos nue, je suis trop excité",
    "eres un idiota de mierda", "vete al infierno, cabrón", "hijo de puta, cállate", "ojalá te mueras de una vez", "los inmigrantes son basura y hay que echarlos", "te voy a matar", "nadie te echaría de menos", "mándame fotos desnuda, estoy muy cachondo",
]
INSULTS = ["idiot", "moron", "asshole", "bastard", "loser", "imbecile", "cretin", "clown", "pig", "parasite", "jackass", "dumbass", "scumbag", "piece of shit", "bitch", "fool", "coward", "prick"]
ADJECTIVES = ["stupid", "useless", "pathetic", "worthless", "brainless", "filthy", "ugly", "disgusting", "lying", "fucking", "dumb", "lazy"]
GROUPS = ["immigrants", "foreigners", "refugees", "women", "old people", "disabled people", "the poor", "people of that faith", "those islanders", "valley folk", "gay people", "the jews", "muslims"]

#: Passages with such words that offend nobody.
HARMLESS = [
    "kill the stuck worker and retry", "the master process hangs and the slave waits", "the dumb terminal flickers", "this idea is garbage collection friendly", "damn, the disk is full again", "i hate how slow the export is", "ugly loss curve and embarrassingly weak baseline",
    "the chicken breast lies next to the pan", "the sculpture of a nude woman is covered", "the naked eye could not follow the ball", "the dog, a bitch of two years, carries the ball", "a rooster, a cock by the old word, runs across the yard", "sex and age of the persons were not recorded", "sexual or violent clips are excluded beforehand",
    "women and men of all ages take part", "the word idiotproof was removed from the guide", "this is a stupid bug in the loader", "what a crappy interface", "the shot was fired from the left of the frame", "the process died and was killed by the system", "execute the script and abort on error", "strip the white space and dump the table", "a bare wall behind the bed", "the pig and the dog walk through the yard", "the clown juggles in the street", "immigrants and refugees were interviewed for the study", "the foreigner asks for the way", "disabled people use the ramp on the left", "old people sit on the bench",
    "i disagree with this key, the answer is wrong", "your annotation is wrong in three places", "this is the worst export i have seen", "nobody touches the box", "the poor light hides the cup", "he beats the eggs in a bowl", "she lies on the bed and reads", "the hole in the fence is visible", "the worker sweats and drinks", "the parasite class in the code is unused", "the garbage truck passes", "hit the button to stop the run", "break the tie by frame number", "the bare cable hangs from the ceiling",
    "ich hasse diesen langsamen export", "der hund liegt tot auf der straße im film", "das schwein läuft über den hof", "so ein blöder fehler im skript", "die ausländer im film warten auf den zug", "je déteste attendre la fin de l'export", "quelle image sale, il faut nettoyer", "les étrangers attendent le train", "qué lente tan sucia, hay que limpiarla", "los inmigrantes esperan en la estación", "odio esperar la exportación",
]
