"""Voters on abusive, hateful and sexually explicit language in English, German, French and Spanish.

Word classes (who is addressed, insults, groups, what groups are demeaned as, violence, bodies, sexual acts and parts, negation)
are inflected by rule; voters are patterns of grammar over them: an insult said to an addressee, a first person with a violent verb and
the addressee's body, a group with a demeaning predicate, a sexual act on somebody's body. A voter is tried on a sentence only if every
class that it names occurs in it, which is told from the sentence's words alone.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


def _w(text: str) -> set[str]:
    return set(text.split())


def _plural(text: str) -> set[str]:
    """English or Romance nouns with their plurals."""
    return {x for w in text.split() for x in (w, w + "es" if w.endswith(("s", "x", "ch", "sh")) else w[:-1] + "ies" if w.endswith("y") and w[-2] not in "aeou" else w + "s")}


def _verb(text: str) -> set[str]:
    """English verbs with -s, -ed and -ing."""
    out = set()
    for w in text.split():
        stem = w.removesuffix("e")
        twice = w + w[-1] if re.search(r"[^aeiou][aeiou][bgnpt]$", w) else stem
        out |= {w, w + ("es" if w.endswith(("s", "sh", "ch", "x")) else "s"), twice + "ed", twice + "ing"}
    return out


def _german(text: str) -> set[str]:
    """German adjectives with their endings."""
    return {w + e for w in text.split() for e in ("", "e", "er", "es", "en", "em")}


def _french(text: str) -> set[str]:
    return {w + e for w in text.split() for e in ("", "s", "" if w.endswith("e") else "e", "s" if w.endswith("e") else "es")}


def _spanish(text: str) -> set[str]:
    """Spanish words on -o with -a and plurals; others with their plural."""
    return {x for w in text.split() for x in ((w, w[:-1] + "a", w + "s", w[:-1] + "as") if w.endswith("o") else (w, w + ("s" if w[-1] in "aeiou" else "es")))}


# The word classes.
CLASSES: dict[str, set[str]] = {
    "you": _w("you your yours you're you've you'll you'd youre u ur ya yourself yourselves thou thee"),
    "du": _w("du dich dir dein deine deinen deinem deiner deines ihr euch euer eure euren"),
    "tu": _w("tu te toi ton ta tes t'es t vous votre vos tú ti tus tuyo tuya eres contigo vosotros os usted ustedes vuestra vuestro"),
    "i": _w("i i'll i'm i'd we we'll we're we'd ich wir je j'ai nous on yo nosotros te les los someone somebody they they'll he he'll jemand quelqu'un alguien"),
    # insults that need nothing else, and those that are insults when said of a person
    "insult": _plural("moron idiot imbecile dunce jackass dumbass scumbag bastard halfwit bitch slut whore cunt asshole arsehole motherfucker prick wanker twat retard shithead dickhead cretin nitwit dimwit lowlife numbskull simpleton blockhead airhead bonehead fuckwit douchebag skank crybaby fucktard dumbo crackhead dipshit knobhead bellend tosser shitbag bimbo")
    | _w("idiotin idioten trottel trotteln vollidiot vollidioten arschloch arschlöcher drecksau miststück hurensohn hure huren schlampe schlampen depp deppen vollpfosten wichser fotze missgeburt penner versager blödmann dummkopf dreckskerl drecksack mistkerl pisser spasti mongo schwachkopf schweinehund hohlkopf nichtsnutz arschgeige flachzange")
    | _plural("connard connasse salope pute enculé abruti abrutie crétin crétine salaud débile bouffon pouffiasse imbécile pétasse enfoiré enfoirée conne trouduc tocard minable clochard")
    | _w("gilipollas cabrón cabrona cabrones puta putas puto putos hijoputa pendejo pendeja pendejos subnormal subnormales tarado tarada cretino cretina capullo capulla maricón maricones imbécil imbéciles idiota idiotas estúpido estúpida estúpidos estúpidas malnacido malnacida mamón payaso payasa desgraciado desgraciada pringado boludo huevón"),
    "mean": _plural("loser clown coward liar parasite pig rat degenerate creep fool scum trash garbage vermin filth worm snake leech maggot weasel freak nobody failure disgrace cow dog hag toad hypocrite swine pervert psycho lunatic animal monster disease joke waste muppet jerk monkey ape sewer")
    | _w("schwein schweine sau spast ratte kakerlake abschaum dreck stück kröte null opfer feigling lügner parasit ziege kuh affe hund müll nichts con cons ordure ordures porc porcs chien chienne rat déchet déchets parasite menteur menteuse lâche raté ratée inútil inútiles zorra zorras cerdo cerda rata ratas basura mierda perro perra escoria cobarde mentiroso mentirosa fracasado fracasada inútil burro burra asno vago vaga tonto tonta vaca"),
    "slur": _w("stupid dumb idiotic moronic filthy rotten worthless pathetic miserable disgusting brainless useless spineless ugly vile lousy wretched retarded stinking fat lazy clueless gutless incompetent hideous repulsive revolting dirty nasty sick crazy damned lying insane dense thick dumbest stupidest ugliest laziest dimmest")
    | _german("dumm blöd elend dreckig widerlich hässlich wertlos erbärmlich ekelhaft dämlich bescheuert nutzlos unfähig fett faul behindert hirnlos jämmerlich mies verlogen verdammt beschissen")
    | _french("pauvre sale minable stupide bête laid moche débile nul répugnant dégoûtant dégueulasse inutile pathétique misérable gros idiot") | _w("grosse nulle nulles conne bêtes")
    | _spanish("asqueroso maldito estúpido tonto inútil patético miserable feo repugnante imbécil gordo sucio puerco idiota"),
    "profane": _w("fuck fucking fucked fucker fuckin shit shitty bullshit screw damn piss bugger sod bloody hell arse ass crap gueule merde putain bordel foutre mierda joder coño carajo hostia verpiss verpisst fick fickt fresse maul klappe schnauze scheiße scheiss scheiß arsch leck culo cul cállate cállense callaos cierra ferme fermez"),
    "bad_words": _w("trash garbage shit crap filth dirt scum dreck scheiße merde mierda basura ordure flesh lies puke dung space skin puta perra"),
    "shut": _w("shut trap mouth face gob hole maul fresse klappe schnauze gueule bouche boca pico ferme fermez cierra cállate callate calla cállense stfu"),
    "group": _plural("immigrant foreigner refugee migrant muslim jew christian arab african asian black gay lesbian homosexual transgender transsexual catholic protestant hindu sikh gypsy mexican chinese indian pole turk russian roma atheist northerner southerner easterner westerner islander villager feminist woman female stranger outsider newcomer believer infidel nomad")
    | _w("women girls mexicans blacks whites disabled handicapped poor homeless elderly accent accents faith religion race skin colour color people folk folks kind tribe sort lot them trans gays jewish muslim immigrants")
    | _w("ausländer ausländern ausländerin flüchtling flüchtlinge flüchtlingen frauen frau juden jude schwule schwulen lesben moslems moslem muslime muslimen behinderte behinderten zigeuner zigeunern migranten schwarze schwarzen türken araber arabern polen russen asylanten leute menschen homosexuelle asiaten afrikaner weiber")
    | _plural("étranger réfugié immigré migrant femme juif musulman arabe homosexuel handicapé noir gitan asiatique africain chinois rom lesbienne") | _w("gens pédés handicapés noirs")
    | _spanish("extranjero refugiado inmigrante judío musulmán gitano homosexual discapacitado negro moro árabe africano chino migrante") | _w("mujeres mujer musulmanes lesbianas gays gente sudacas"),
    "demean": _plural("vermin animal rat cockroach parasite plague cancer disease pest insect pig dog ape monkey savage thief criminal rapist terrorist murderer liar leech beast barbarian burden virus locust invader maggot scrounger cheat swine") | _w("vermin filth scum subhuman subhumans garbage trash dirt poison infected thieves thieving criminal dangerous evil inferior primitive worthless stupid lazy filthy dirty dumb disgusting uncivilised uncivilized unfit useless sick mad weak dishonest greedy violent breed breeds breeding multiply infest infesting swarm swarming crawl crawling invade invading ruin ruining destroy destroying steal stealing")
    | _w("ungeziefer abschaum tiere tier parasiten pest ratten ratte dreck verbrecher diebe kriminelle kriminell terroristen krank dumm blöd faul minderwertig schmarotzer gesindel pack untermenschen affen kakerlaken plage dreckig gefährlich primitiv seuche")
    | _w("vermine animaux bêtes parasites voleurs criminels terroristes malades rats cafards inférieurs inférieures inférieur sales stupides connes peste racaille sauvages singes violeurs fainéants paresseux fléau dangereux dégoûtants")
    | _w("plaga escoria ratas animales ladrones criminales terroristas parásitos inferiores delincuentes salvajes basura monos vagos sucios enfermos violadores cucarachas tontas tontos estúpidas estúpidos peligrosos invasores"),
    "expel": _verb("deport expel evict remove ban exterminate eradicate eliminate sterilise sterilize gas hang shoot burn kick throw drive lock jail whip beat castrate cleanse segregate purge kill disappear vanish die suffer leave") | _w("deported driven drove thrown out away back shot hung hanged gone get go keep round rid send ship extinct vanish cage caged beaten burnt")
    | _w("weg raus fort abgeschoben abschieben vernichtet vergast verschwinden verschwindet eingesperrt weggesperrt ausgerottet rausgeworfen vertrieben verbrannt heim dehors expulser expulsés expulsées renvoyer dégagent dégager virer disparaître exterminer brûler enfermer enfermés enfermer chasser éliminer gazer expulsar expulsarlos expulsados echar echarlos echarlas larguen largarse fuera exterminar eliminar quemar quemarlos encerrar encerrarlos matarlos desaparecer desaparezcan deportar deportarlos"),
    "deny": _w("not never no don't doesn't shouldn't cannot can't nobody none nor without nicht kein keine keinen nie niemals pas jamais aucun aucune rien no nunca jamás ningún ninguna nadie ni mustn't won't isn't aren't"),
    "due": _w("deserve deserves deserved right rights vote votes voting human humans equal allowed belong belongs trust trusted hire hired employ marry mix welcome live home worthy treated respect place decent let menschen wählen verdienen recht rechte gleich einstellen trauen leben méritent mérite droit droits humains vivre voter confiance embaucher épouser merecen merece derecho derechos votar humanos personas vivir confiar contratar deberían casarse personne respect respeto"),
    "violent": _verb("kill murder beat smash break stab shoot strangle choke slap punch kick crush slit gut burn bash hurt destroy cut rip tear hang drown bury slice skin torture rape hit knock shoot end finish run") | _w("beaten broke broken shot slit hung torn bullet knife gun bat hammer fist axe cave throat hole put wring")
    | _w("umbringen umbring bring bringe töte töten schlag schlage schlagen brech breche brechen stech stechen absteche abstechen erschieße mach mache haue hau polier prügel prügeln kalt fertig messer tuer tue casser casse crever crève buter bute frapper frappe démolir défoncer défonce éclater éclate égorger massacrer péter exploser étrangler poignarder matar mato partir parto romper rompo reventar reviento rajar rajo golpear pegar destrozar acuchillar degollar hundir estrangular"),
    "body": _plural("jaw face head neck tooth leg skull throat arm bone nose rib knee finger back brain eye gut ass spine mouth") | _w("teeth kneecaps") | _w("zähne fresse schädel gesicht knochen genick beine beine nase hals kopf schnauze arme finger figure gueule tête dents cou jambes nez os bras crâne genoux cara piernas dientes cuello cabeza huesos nariz brazos boca cráneo garganta costillas"),
    "death": _w("die dies dying dead death rot choke burn suffer drown hang bleed cancer grave morgue coffin hospital hell jump bridge rope kill miss missed born alive live crash vanish vanished gone funeral funerals suffocate perish beaten accident accidents worse better stillborn abort aborted sterben stirb stirbst verreck verrecke verreckst krepier krepierst tot abkratzt umbringen leben geboren mourir meurs meures crever crèves crève mort morte né née vivre morir muere mueras muérete muerto muerta revientes nacido nacer vivir púdrete pudras infierno enfer hölle krankenhaus"),
    "wish": _w("hope hopes wish should pray want wants better favor favour world nobody everyone shame pity hoffentlich hoffe wünschte solltest sollte besser espère souhaite devrais vivement mieux ojalá espero deberías ojala mejor do just go nobody drop why please"),
    "menace": _w("dare try say carry watch know knows wait waiting find careful next regret pay sleep coming come accidents happen warn warned warning home house family kids children wife live lives sleep park school car alone tonight door dark keep later someday eyes careless hide sorry last street meet weißt wissen warte warten pass aufpassen wohnst bereuen kriege krieg finde sais savons habites attends attendre regretter paieras trouverai gaffe prochaine sé sabemos vives espera espero arrepentir arrepentirás pagarás encontraré cuidado próxima wo où dónde"),
    "nobody": _w("nobody none everyone everybody no-one no all niemand keiner alle personne tous nadie todos every whole entire anyone anybody"),
    "feel": _verb("like love want need hate despise loathe stand care miss bear tolerate laugh detest regret respect pity trust") | _w("ashamed shame embarrassed embarrassment disgusted disgust disgrace sick sorry burden mistake mag mögen liebt hasst hassen hasse leiden braucht brauchen schämt schämen vermisst aime aiment supporte supportent veut déteste détestent besoin honte regrette manquera quiere quieren soporta soportan odia odian aguanta vergüenza necesita asco pena"),
    "smell": _verb("smell stink reek") | _w("stinkst stinkt stank riechst pues puez empestes apestas hueles odor breath rancid"),
    "kin": _w("mother mum mom father dad parents family wife husband kids children son daughter relatives mutter vater eltern familie mère père parents madre padre padres familia raised raise birth bore born"),
    "act": _verb("fuck thrust penetrate ejaculate climax masturbate moan lick suck straddle grope fondle undress spank bang screw stroke caress finger gasp groan cum hump wank orgasm strip ride mount shag rub") | _w("rode ridden sucked came come naked nude sex orgasm blowjob bj handjob doggy anal deepthroat horny aroused wet hard erect slid")
    | _w("ficken fickte fickten fick gefickt trieben treiben bumsen bumste vögeln vögelte vögelten stöhnte stöhnten stöhnt stöhnen leckte lecken blasen blies steckte kam kamen geil geile geiler reiten ritt sex höhepunkt nackt nackte orgasmus wichsen streichelte masturbierte baiser baisa baisèrent baisent sucer suça lécher lécha pénétra pénétrer pénétrait gémit gémissait gémir gémissements jouir jouit jouissance chevaucha caressa enfila branler masturber sexe orgasme nue nu follar folló follaron follaba follando chupar chupó lamer lamió penetró penetrar gimió gemía gemidos correrse corrió orgasmo masturbar masturbó cabalgó metió sexo desnudo desnuda desnudos desnudas placer tocarse acarició"),
    "part": _plural("breast tit boob nipple thigh cock dick pussy cunt panty vagina penis clit buttock crotch groin ass butt bum erection balls testicle boner") | _w("bare tits boobs underwear panties lingerie bra lap hips loins inside mouth tongue lips knees legs clothes zipper trousers blouse dress shirt skirt shorts jeans body")
    | _w("titten brüste brust schwanz muschi fotze möse arsch nippel schenkel schenkeln höschen slip bluse unterwäsche hose beine bh kitzler schoß seins sein tétons bite chatte cul cuisses culotte nichons queue slip soutien-gorge chemisier jupe jambes fesses pénis tetas pechos pezones polla coño culo muslos bragas tanga verga blusa falda sujetador piernas camisa pene ropa"),
    "of_whom": _w("his her him she he my me your you their them each other it ihr ihre ihren ihrem ihm sein seine seinen seinem sie er dir mir mich dich deine meine meinen lui elle il leur sa son ses ta tes tes moi toi ma mes su sus le la me mi tu tus él ella te se les ambos"),
    "bare": _w("nude nudes naked topless undressed horny sexy porn porno xxx explicit hardcore sex erotic uncensored nsfw onlyfans milf milfs sluts nacktbilder nacktfotos nackt nackte nackten geil geile porno pornos nue nues nus nu porno sexe sexy coquine coquines chaude chaudes dénudée desnudo desnuda desnudos desnudas porno sexo cachonda cachondas caliente calientes guarras"),
    "ask": _verb("send show share post give take get want need click watch meet cam see touch undress bend spread kneel suck lick imagine dream sit ride chat join") | _w("free live hot videos video pics pic pictures photo photos girls cam webcam dates tonight bed room hotel flat me schick schicke schickt zeig zeige will zieh komm bilder fotos mädchen heute bett zimmer envoie envoyez montre veux viens déshabille écarte photos filles lit chambre chaudes envía envíame manda mándame enséñame muéstrame quiero ven desnúdate ábrete chicas fotos cama habitación gratis kostenlos gratuit"),
    # classes of voters against
    "policy": _w("policy policies rule rules bans banned prohibits prohibited moderation moderator moderators harassment guidelines guideline forbidden forbids conduct report reported reports law court trial judge police survey study article definition training insults threats abuse offensive discrimination complaint slur term word words called accused sentenced richtlinie richtlinien verbietet verboten moderation beleidigungen beleidigung hassrede regel regeln gesetz gericht polizei diskriminierung règlement interdit interdite interdites modération charte loi tribunal police insultes menaces harcèlement propos règle règles discrimination reglamento prohíbe prohibido prohibidos normas política moderación ley tribunal policía insultos amenazas acoso discriminación"),
    "clinical": _w("patient patients clinic doctor nurse therapy screening examination exam cancer contraception health healthcare treatment diagnosis vaccinated vaccination symptoms surgery medical hospital ward surgeon midwife consultation mammogram pain tissue anatomy hygiene patientin patienten klinik arzt ärztin gesundheit untersuchung untersucht vorsorge behandlung impfung operation verhütung beratung patiente patients clinique médecin santé dépistage traitement consultation vaccination contraception chirurgie examen paciente pacientes clínica médico salud revisión cribado tratamiento consulta vacunación anticoncepción cirugía mama"),
    "technical": _w("process processes thread threads server kernel connector connectors cable job jobs file files database port socket sockets engine pump software script node cluster bolt nut screws valve bearing cylinder column field row rows data table query plug wire pipe drill motor machine printer prozess datei kabel stecker server pumpe ventil spalte feld winkel daten tabelle maschine motor processus fichier câble serveur pompe vanne colonne champ données machine moteur proceso archivo cable servidor bomba válvula columna campo datos máquina motor tank"),
    "self": _w("i'm myself mine my i bin mir mich meine mein suis moi mon ma soy mío mía mi yo fui silly"),
    "thing": _w("printer app application website update software service machine laptop computer program system phone login password form page device browser mail drucker programm anwendung webseite update rechner handy passwort formular gerät imprimante application logiciel site ordinateur téléphone formulaire appareil service impresora aplicación programa sitio ordenador teléfono formulario aparato servicio contraseña mistake fehler erreur error"),
    "support": _w("receive receives welcome welcomed invited entitled offers offered leaflet help support advice course programme program pay union museum history shared guide room exhibition housing equal inclusion visitors charity erhalten willkommen eingeladen beratung hilfe kurs museum geschichte angebot formular unterstützung reçoivent accueil accueillis accueillies aide dépliant cours musée invité invités soutien peuvent reciben bienvenido bienvenida bienvenidos ayuda folleto curso museo apoyo pueden invitados"),
    "nature": _w("bird birds species breeder breeders kennel puppies puppy litter recipe mushroom mushrooms cattle farm farmer milk milked zoo veterinary pond reserve nest pasture kitchen soup sauce served roast vogel vögel art arten züchter welpen hof tierarzt teich rezept oiseau oiseaux espèce espèces éleveur chiots ferme recette servi pájaro pájaros especie especies criador cachorros granja receta sirve"),
}
CLASSES["insult_any"] = CLASSES["insult"] | CLASSES["mean"]
CLASSES["addressee"] = CLASSES["you"] | CLASSES["du"] | CLASSES["tu"]

#: Words that a disguise may stand for.
KNOWN = frozenset(w for c in ("insult", "mean", "slur", "profane", "bare", "demean", "part", "act", "group", "violent", "death") for w in CLASSES[c] if len(w) >= 3)


class Voter(NamedTuple):
    name: str
    vote: int
    needs: tuple[str, ...]
    pattern: str


def _any(name: str) -> str:
    """A word of a class; letters before a hyphen and digits are a code, not a word."""
    return r"(?<![\w])(?:" + "|".join(sorted(map(re.escape, CLASSES[name]), key=len, reverse=True)) + r")(?!\w|-\d)"


def _gap(n: int, stop: str = "") -> str:
    """At most so many words, none of them across a comma if ``stop`` is one."""
    return rf"(?:[\w'’-]+[,:]?\s+){{0,{n}}}?" if not stop else rf"(?:[\w'’-]+\s+){{0,{n}}}?"


def _voters() -> list[Voter]:
    c = {name: _any(name) for name in CLASSES}
    you, insult, either, slur, group = c["addressee"], c["insult"], c["insult_any"], c["slur"], c["group"]
    be = r"(?:are|is|am|'re|’re|were|was|be|being|look like|sind|ist|bist|seid|sont|est|es|êtes|son|sois|eres|sea|sean|como|comme|wie|like)"
    modal = r"(?:should|must|ought to|need to|needs to|have to|has to|can|may|to|will|shall|would be better|müssen|muss|sollten|sollen|gehören|gehört|doivent|devraient|faut|il faut|devrait|deben|deberían|hay que|tienen que|que se|qu['’]ils|qu['’]on)"
    rows: list[tuple[str, int, str, str]] = [
        ("insult_to_you", 1, "addressee insult_any", rf"{you}[,:]?\s+{_gap(4)}{either}(?!\s+(?:can|could|may|should|file|server)\b)"),
        ("insult_like_you", 1, "addressee insult_any", rf"{either}\s+(?:like|such as|wie|comme|como)\s+{you}"),
        ("insult_called_out", 1, "insult", rf"(?:^|[,;:]\s*){_gap(3, ',')}{insult}\W*$|^\W*{insult}\s*[,!]"),
        ("insult_described", 1, "insult_any", rf"\b(?:he|she|that (?:man|woman|guy|boy|girl)|er|sie|il|elle|él|ella|who|boss|neighbou?r|teacher|colleague)\b[^.]{{0,30}}?\b{be}\s+{_gap(3, ',')}{insult}|\b(?:what an?|such an?|so ein|so eine|quel|quelle|qué|vaya|menudo|espèce de?|pedazo de|bande de?)\s+{_gap(3, ',')}{either}|\b(?:this|these|that|those|diese[rs]?|ces?|cette|est[ea]s?)\s+{_gap(2, ',')}{insult}"),
        ("slur_and_insult", 1, "slur insult_any", rf"{slur}\s+{_gap(1, ',')}{either}|{either}\s+{slur}"),
        ("slur_on_you", 1, "addressee slur", rf"{you}\s+(?:are |'re |look |sound |were |bist |seid |es |êtes |eres |)(?:[\w'’]+\s+){{0,3}}?(?:so |such |too |really |just |the |zu |echt |wirklich |total |trop |vraiment |si |tan |muy |más |)\s*{slur}"),
        ("insult_two", 1, "insult_any", rf"{either}\s+(?:and|und|et|y|,)\s+(?:an?\s+|ein[en]?\s+|une?\s+|un[ao]?\s+)?{_gap(2, ',')}{either}"),
        ("made_of_dirt", 1, "bad_words", rf"\b(?:sack|piece|pile|bag|load|heap|lump|bit|stück|haufen|tas|sac|pedazo|saco|montón|hijo|hija|waste) (?:of |de |d['’]|)(?:[\w]+\s+)?(?:{c['bad_words']}|puta)|\bde (?:mierda|merde)\b"),
        ("order_to_leave", 1, "profane", r"\b(?:fuck|screw|piss|bugger|sod|naff)(?:ing)?\s+(?:off|you|your|u|yourself|them|him|her)\b|\bgo (?:to hell|fuck|screw|hang)|\b(?:rot|burn) in hell|\b(?:kiss|lick|suck) my\b|\beat shit|\byou (?:fucking|bloody|damn)|\bverpiss|\bfick dich|\bleck mich|\bva te faire|\bvete a (?:la mierda|tomar|la)|\bque te (?:jodan|den|follen)|\bje t['’]emmerde|\bcasse[- ]toi|\bnique ta|\bchinga tu|\bjódete"),
        ("order_silence", 1, "shut", r"\bshut (?:your|ya|ur|the (?:fuck|hell))\s+(?:[\w]+\s+){0,2}?(?:trap|mouth|face|gob|hole|pie|cakehole|up)\b|\bshut it\b|\bshut up\b|\bstfu\b|\bhalt(?:et|'s)?\s+(?:[\w]+\s+){0,3}?(?:maul|fresse|klappe|schnauze)|\bferme[zs]?-la\b|\bferme[zs]? la\W*$|\bta gueule|\bferme ta|\bla ferme\b|\bcierra (?:la|el|esa|tu)\s+(?:[\w]+\s+)?(?:boca|pico)(?!\s+del?)|\bc[aá]ll?ate\b|\bcállense\b"),
        ("back_to_hole", 1, "addressee", rf"\b(?:crawl|slither|go|get)\s+(?:back|away)?\s*(?:in|into|to|under|behind)\s+(?:the|your|that|whatever)\s+{_gap(2)}(?:hole|rock|sewer|gutter|cave|swamp|slum|dump|cage|pit)"),
        ("smells", 1, "addressee smell", rf"{you}\s+{_gap(3)}{c['smell']}"),
        ("nobody_wants_you", 1, "addressee nobody feel", rf"{c['nobody']}\s+{_gap(5)}{c['feel']}\s+{_gap(3)}{you}"),
        ("hated", 1, "addressee feel", rf"\b(?:i|we|all|ich|wir|je|nous|on|yo)\s+(?:[\w]+\s+){{0,2}}?(?:hate|despise|loathe|detest|can'?t stand|cannot stand|hasse|hassen|verachte|déteste|méprise|odio|desprecio)\s+{you}|\b(?:te|vous) (?:odio|detesto|déteste|méprise)|\bdas pena\b|\bdas asco\b|\btu (?:me )?(?:dégoûtes|fais pitié)|\bme das asco"),
        ("kin_ashamed", 1, "addressee kin feel", rf"(?:{you}\s+{_gap(1)}{c['kin']}\s+{_gap(6)}{c['feel']}|{c['kin']}\s+{_gap(6)}{c['feel']}\s+{_gap(5)}{you}|\b(?:ashamed|sorry|sick|disgusted|embarrassed|regrets?)\s+(?:of|to|about|at|by|that|for)?\s*{_gap(4)}{c['kin']}\s+{_gap(3)}{you})"),
        ("harm_body", 1, "addressee violent body", rf"{c['violent']}\s+{_gap(3)}(?:your|dir|dein\w*|te|ta|tes|ton|vos|la|las|los|tu|tus|el|el)\s+{_gap(2)}{c['body']}|\b(?:dir|te|euch)\s+(?:[\w]+\s+){{0,3}}?{c['body']}[\w\s]{{0,12}}?(?:ein|aus|brechen|schlagen|einschlagen|brech|kaputt)\b|(?:your|dein\w*|ta|tes|tu|tus)\s+{c['body']}\s+(?:in|off|open|apart|ein|ab|against|through)\b|\bschlag\w* (?:dir|euch)\b"),
        ("harm_you", 1, "addressee violent", rf"\b(?:i|we|someone|somebody|they|he)(?:['’]ll|['’]m|['’]d| will| am| are| shall| would| want| should| could| swear| just| might| must|)\s+{_gap(5)}{c['violent']}\s+{_gap(2)}(?:you|your\b(?!\s+(?:process|job|laptop|data|files?|order|request|ticket|phone|computer|session)))|\bich\s+{_gap(4)}{c['violent']}\s+{_gap(2)}(?:dich|dir|euch)\b|\b(?:bring\w*|stech\w*|mach\w*|schlag\w*|prügel\w*)\s+(?:dich|euch)\b(?!\s+(?:in|auf|nützlich|bereit|vertraut|bemerkbar))|\b(?:je|on|nous)\s+(?:vais|va|allons)\s+{_gap(2)}(?:te|vous|l['’])\s*{_gap(1)}{c['violent']}|\b(?:te|os|lo|la)\s+(?:voy|vamos|van)\s+a\s+{_gap(1)}{c['violent']}|\bkill you\b|\bbe the death of you"),
        ("harm_told", 1, "addressee death", rf"{you}\s+(?:will|'ll|are going to|gonna|shall|are|wirst|vas|vas a|irás|going)\s+{_gap(5)}(?:die|dead|bleed|suffer|hospital|grave|morgue|coffin|burn|sterben|mourir|crever|morir|hell)\b|\b(?:see|put|send|want|like|bury|find|leave|make|get)\s+{you}\s+{_gap(4)}(?:dead|beaten|hang\w*|bleed\w*|die|dying|suffer|hospital|grave|morgue|coffin|burn\w*|ground|crawl)\b"),
        ("death_wished", 1, "addressee wish death", rf"\b(?:hope|wish|pray|hoffentlich|hoffe|wünsch\w*|espère|souhaite|vivement|ojalá|ojala|espero)\s+{_gap(2)}(?:que |dass |)(?:{you}\s+)?{_gap(6)}(?:die|dies|dying|dead|rot|choke|burn|suffer|drown|hang|bleed|cancer|crash|perish|suffocate|verreck\w*|stirbst|sterben|krepier\w*|crev\w*|crèves?|meur\w*|muer\w*|mueras|pudras|revientes|hell|infierno)\b"),
        ("better_without_you", 1, "addressee", rf"\b(?:world|we|everyone|everybody|all|welt|monde|mundo)\b[\w\s'’]{{0,30}}?\bbetter (?:off |place )?(?:without|if) {you}|\b(?:nobody|no one|none|niemand|personne|nadie)\s+{_gap(3)}(?:miss|notice|cry|mourn|care|vermiss\w*|regrett\w*|manqu\w*|echar\w*)\s*{_gap(3)}(?:{you}|if)|\bwaste of (?:space|skin|oxygen|air|breath)|\b(?:should|wish)\s+{_gap(4)}(?:never|not)\s+(?:have )?been born|\b(?:us|everyone|everybody|the world)\s+{_gap(2)}a favou?r\b"),
        ("told_to_die", 1, "death", r"\b(?:kill|hang|shoot|drown|off|end)\s+(?:yourself|urself|yourselves|your (?:own )?life)\b|\bdrop(?:ped)? dead\b|\bgo (?:and |away and )?(?:die|hang|drown|rot)\b|\b(?:you|us|everyone|why don['’]t|go|just)\b.*\bjump (?:off|from|in front|under)\b|\bstirb\b|\bbring dich (?:doch )?(?:selbst )?um|\bva (?:crever|mourir)|\bcrève\b|\bmuérete\b|\bpúdrete\b|\btírate\b|\bmátate\b|\bkrepier\b|\bverrecke?\b"),
        ("stalked", 1, "addressee menace", rf"\b(?:know|knows|found out|find out|see|saw|weiß|wissen|sais|savons|sé|sabemos)\s+(?:exactly |well |very well |genau |très bien |bien |muy bien |)(?:where|which|when|wo|wann|où|quelle?|dónde|cuándo|what)\s+{_gap(3)}(?:{you}|vives|habites|wohnst|trabajas|travailles)(?!\s+(?:need|want|mean|asked|ordered|saved|can|should|put|left))|\bwatch your (?:back|step around)|\bsleep with (?:one|your) eye|\baccidents (?:can |do |will |)happen\b|\b(?:wait|waiting|coming|come|look|looking|hunt|hunting)\s+(?:for|after)\s+you\b[\w\s,]{{0,50}}?\b(?:knife|gun|bat|dark|alone|night|outside|friends|fists?)\b|\b(?:you|you'll)\s+(?:will |are going to |gonna |)(?:regret|pay for|be sorry|wish you)\b|\bwill find you\b"),
        ("or_else", 1, "addressee menace", rf"\b(?:keep|carry on|dare|try|say)\s+(?:\w+ing|that|it|this|one more)\b[\w\s]{{0,25}}?\b(?:and|or)\s+(?:you|your|i|we|somebody|someone)\b[\w\s'’]{{0,30}}?{c['violent']}|\bkeep (?:talking|writing|posting|coming|asking|lying|looking)\s+and\s+(?:you|your|i)\b[^.]{{0,40}}?(?:{c['body']}|{c['death']}|lose|find|end up)|\bnext time\s+{_gap(2)}(?:i|we)(?:['’]ll| will| won['’]?t|['’]m)\b[\w\s]{{0,30}}?(?:{c['violent']}|{c['body']}|\bnot miss\b|\bnot be so\b)"),
        ("group_is_demeaned", 1, "group demean", rf"{group},?\s+{_gap(7)}{be}\s+{_gap(5)}{c['demean']}"),
        ("demeaned_group", 1, "group demean", rf"{c['demean']}\s+{group}|\b(?:those|these|all|such|diese|diese[rs]?|ces|tous ces|esos|esas|estos|estas)\s+{group}\W{{0,2}}\s*{_gap(3)}{c['demean']}|\b(?:those|these|ces|esos|esas|diese|nothing but|lauter|que des|puros)\s+{c['demean']}\b[^.]{{0,30}}?{group}|{group}\s+(?:\w+\s+){{0,2}}?(?:breed|breeds|multiply|infest|swarm|spread)\b"),
        ("group_too_stupid", 1, "group", rf"{group}\s+{_gap(5)}(?:too|zu|trop|demasiado)\s+(?:stupid|dumb|lazy|weak|dirty|dumm|blöd|faul|schwach|bêtes?|stupides?|connes?|faibles?|idiotes?|tont[ao]s|estúpid[ao]s|débiles)|{group}\b[^.]*\b(?:in|within) (?:their|its) (?:blood|nature|genes|dna)\b|{group}\b[^.]{{0,40}}?\bby nature\b|\bonly (?:understand|respect|know|learn)\s+(?:the\s+)?(?:violence|force|whip|stick|fist|belt|pain|fear)|\b(?:understand|learn|respect)s?\s+(?:only |nothing but )(?:the\s+)?(?:violence|force|whip|stick|fist|belt|pain|fear)"),
        ("group_expelled", 1, "group expel", rf"{group}\b[^.]{{0,60}}?\b{modal}\s+{_gap(4)}{c['expel']}(?!\s+(?:to school|to work))|\b(?:deport|expel|kick|throw|drive|keep|get|send|round|lock|ban|remove|clear|wipe|hunt|chase|ship|put|burn|gas|shoot|hang)\s+(?:up |out |away |all |rid of |)(?:all |the |these |those |every |any |)\s*{_gap(3)}{group}[\w\s'’,]{{0,40}}?\b(?:out|away|back|up|off|down|key|ships?|boats?|border|cage|camps?|shoot|burn|alive|planes?)\b|{group}\s+(?:raus|dehors|fuera|out)\b|{group}[^.]{{0,30}}\b(?:weg|raus|dégagent|larguen|fuera|echarl[oa]s|expulsarl[oa]s|disappear|verschwinden)\b|\b(?:gas|shoot|hang|exterminate|sterili[sz]e|deport)\s+(?:all |the |them |these |those |every |lot |of |)+\s*{group}"),
        ("group_denied", 1, "group deny due", rf"{group}\b[^.]{{0,60}}?{c['deny']}\s+{_gap(5)}{c['due']}|{c['deny']}\s+{_gap(3)}(?:hire|employ|trust|marry|let|allow|serve|rent to|mix with|respect|einstellen|embaucher|contratar)\s+{_gap(3)}{group}|\b(?:must|should|can|do|does)\s*(?:not|n['’]t)\s+(?:mix|marry|live|breed|mingle|sit|eat)\s+(?:with|among|near|next to)\s+{_gap(3)}{group}|{c['deny']}\s+{c['due']}\s*(?:,|and|or|und|et|y)\s*{c['deny']}\s+{c['due']}"),
        ("group_homes_burnt", 1, "group", rf"\b(?:burn|bomb|torch|destroy|raze|blow up|smash)\s+(?:down )?(?:their|all their|every)\s+{_gap(1)}(?:houses?|homes?|mosques?|synagogues?|temples?|churches|shops|villages?|camps?)|\b(?:taking over|stealing|ruining|invading|polluting|infecting|poisoning|infected|polluted|poisoned|ruined)\s+(?:our|my|this|the whole)\s+(?:country|jobs|women|town|city|village|blood|culture|land|street|nation|neighbou?rhood)|\bgo back to (?:your|their)\s+(?:own )?(?:country|countries|desert|jungle|caves?)|\bout of our\s+(?:country|town|village|schools?|streets?|neighbou?rhood|land|city|clubs?|shops?)"),
        ("act_on_body", 1, "act part of_whom", rf"{c['act']}\s+{_gap(6)}{c['of_whom']}\s+{_gap(3)}{c['part']}|{c['part']}\s+{_gap(7)}{c['act']}[^.]*?{c['of_whom']}|{c['of_whom']}\s+{_gap(2)}{c['part']}[\w\s,]{{0,40}}?{c['act']}"),
        ("act_on_person", 1, "act of_whom", r"\b(?:rode|ridden|riding|fucked|fucking|licked|licking|sucked|sucking|shagged|banged|humped|mounted|fingered)\s+(?:\w+ly\s+)?(?:him|her|me|it|them|you|each other)\b(?!\s+(?:home|to|into the station|back to))|\b(?:until|till|bis|jusqu['’]à ce que?|hasta que)\s+[\w\s'’]{1,25}?(?:climax\w*|orgasm\w*|came(?!\s+(?:back|home|to|in|out|up|down|over|across|along|from|with|for|by|off|on|at|and took))|kam(?:en)?\b(?=\W*$)|jouit|joui(?:r|ssent)|corri(?:ó|eron)|gritó)|\b(?:moan|groan|gasp|pant)(?:ed|ing|s)?\s+(?:as|while|when|with|his|her|in)\b[^.]{0,40}?\b(?:he|she|his|her|they|pleasure)|\b(?:trieben|treiben) es\b|\b(?:se|lo|la) (?:follaron|folló|follaba)|\bbais(?:a|èrent|aient|ent)\b|\bvögel\w*|\bfickt?e?n?\b|\bpénétra\b|\bpenetró\b"),
        ("rough_sex", 1, "act", r"\b(?:rough|anal|oral|hardcore|hot|raw|unprotected|wild|kinky|dirty|hard|passionate|steamy)\s+sex\b|\bhad sex\b(?=.*\b(?:him|her|bed|table|floor|times|hard|desk|kitchen|couch|sofa|car)\b)|\bblowjob|\bhandjob|\bdeepthroat|\bdoggy style"),
        ("clothes_torn", 1, "part of_whom", r"\b(?:tore|ripped|pulled|slid|took|peeled|unzipped|unbuttoned|unhooked|lifted|yanked|slipped|tugged|dropped|pushed)\s+(?:(?:off|down|up|open|away|aside|out of)\s+)?(?:his|her|my|their|your)\s+(?:\w+\s+)?(?:clothes|bra|panties|underwear|dress|shirt|blouse|skirt|pants|jeans|trousers|zipper|fly|shorts|knickers|lingerie|top|nightgown)\b|\b(?:arranc|quit|baj|levant|sub)(?:ó|aron)\s+(?:la|las|el|los|le|su|sus)\s+(?:bragas|ropa|blusa|falda|camisa|sujetador|vestido|tanga|pantal\w+)|\b(?:arrach|retir|enlev|soulev|baiss|déchir)(?:a|èrent|ait)\s+(?:sa|son|ses|la|le)\s+(?:culotte|jupe|chemis\w+|robe|soutien\S*|slip|pantalon|vêtements)|\b(?:riss|zog|knöpfte|schob|streifte)(?:en)?\s+(?:ihr|ihm|sich)\s+(?:[\w]+\s+){0,2}?(?:bluse|höschen|slip|hose|hemd|kleid|rock|bh|unterwäsche|kleider)"),
        ("head_pushed", 1, "part of_whom", r"\b(?:push|press|pull|guid|forc|shov|mov|ran|run|slid)(?:e|ed|es|ing)?\s+(?:his|her|my|the)\s+(?:\w+\s+)?(?:head|mouth|hand|hands|fingers|face|tongue|lips)\s+[\w\s]{0,25}?(?:his|her|my|between|inside)\b[\w\s]{0,12}?(?:legs|thighs|crotch|cock|dick|pussy|breasts?|tits|panties|skirt|blouse|shirt|trousers|pants|lap|groin|zipper|underwear|body|knees)?"),
        ("asked_for_nudes", 1, "ask bare", rf"{c['ask']}\s+{_gap(5)}{c['bare']}|{c['bare']}\s+{_gap(4)}{c['ask']}"),
        ("asked_for_body", 1, "ask part", rf"\b(?:send|show|give|want to (?:see|touch|lick|kiss|feel|taste|suck)|let me (?:see|touch|lick|feel|taste)|zeig\w*|schick\w*|montre\S*|envoie\S*|enséñame|muéstrame|manda\w*|quiero (?:ver|tocar|lamer|besar))\s+{_gap(3)}(?:your|ur|deine?n?|tes|ta|ton|tus?|las|el|every|all)\s+{_gap(3)}{c['part']}"),
        ("asked_idiom", 1, "ask", rf"\b(?:lick|kiss|taste|touch|suck)\s+every\b|\bbend over\b(?!\s+(?:to|and lift|backwards))|\bspread your\b(?!\s+(?:work|wings|costs|payments))|\bget on your knees|\btake off your\b[\w\s]{{0,15}}?(?:clothes|panties|bra|shirt|dress|underwear|pants|top|blouse|skirt)|\btouch yourself|\bsit on my\b|\b(?:how|so) (?:wet|hard|horny) (?:you|i|she|he)\b|\b(?:zieh dich|déshabille|desnúdate)"),
        ("wanted", 1, "addressee ask", rf"\b(?:i|we)\s+(?:[\w']+\s+)?(?:want|need|imagine|dream of|think of|would love|can't wait|crave)\s+(?:to \w+ )?(?:you|your)\b[\w\s]{{0,20}}?\b(?:naked|nude|undressed|bed|knees|under me|inside|wet|legs|thighs|mouth|bent|tied|moan\w*|on top)\b|\bcome (?:to|over to|up to|by) my (?:room|bed|place|hotel|flat|apartment|house)\b[\w\s,]{{0,40}}?\b(?:naked|nothing|night|tonight|alone|wear\w*|fun|undress\w*)\b|\b(?:spank|whip|tie up|fuck|ravish|seduce|undress)\s+(?:you|your|u)\b|\b(?:naughty|dirty|bad|little|sexy)\s+(?:girl|boy|slut|whore|bitch)\b"),
        ("sex_traded", 1, "bare", rf"\b(?:hot|free|live|explicit|hardcore|amateur|xxx|horny|naked|nude|sexy|uncensored|wild|dirty)\s+(?:\w+\s+)?(?:porn|xxx|sex|nudes?|girls|women|milfs|singles|cams?|webcams?|videos?|pics|sluts|housewives|babes|chat)\b(?=.*(?:{c['bare']}))|\b(?:porn|xxx|nackt\w*|porno\w*)\s+(?:videos?|pics|clips|sites?|photos|bilder|filme)"),
        ("policy", -1, "policy", c["policy"]),
        ("clinical", -1, "clinical", c["clinical"]),
        ("technical", -1, "technical", rf"{c['technical']}(?!.*\b(?:you|du|dich|dir|tu|te|eres)\b)"),
        ("own_fault", -1, "self", rf"\b(?:i am|i['’]m|i was|i feel|made me feel|i forgot|silly me|stupid me|ich bin|ich war|je suis|j['’]étais|j['’]ai (?:été|oublié)|soy|fui|estuve|he sido)\b|\b(?:of mine|my own|von mir|de ma part|mea culpa|mío|mía|meine schuld|ma faute|culpa mía)\b"),
        ("complaint", -1, "thing", rf"(?:{c['slur']}|{c['profane']}|\bfichue?|\bblöde\w*)\s+{_gap(1)}{c['thing']}|{c['thing']}\s+{_gap(3)}(?:crash\w*|fail\w*|froze|broke\w*|stopp\w*|slow|jam\w*|stürzt|hängt|kaputt|plante|bloque|marche pas|falla|bloquea|funktioniert nicht|no funciona|cuelga)"),
        ("support", -1, "support", rf"{c['support']}(?!.*\b(?:not|never|nicht|pas|no|nunca)\b)"),
        ("nature", -1, "nature", rf"{c['nature']}(?!.*\b(?:you|du|dich|eres|they are|sont|sind)\b)"),
    ]
    return [Voter(name, vote, tuple(needs.split()), pattern) for name, vote, needs, pattern in rows]


VOTERS: list[Voter] = _voters()
NAMES: list[str] = sorted(CLASSES)
BIT: dict[str, int] = {n: i for i, n in enumerate(NAMES)}


@lru_cache(maxsize=1)
def compiled() -> list[re.Pattern[str]]:
    return [re.compile(v.pattern) for v in VOTERS]


@lru_cache(maxsize=1)
def word_masks() -> dict[str, int]:
    """Every word of the classes with the classes that it belongs to, one bit each; parts of words joined by signs count too."""
    masks: dict[str, int] = {}
    for name, words in CLASSES.items():
        for w in words:
            for part in {w, *re.findall(r"[^\W\d_]+", w)} if not w.isalpha() else {w}:
                masks[part] = masks.get(part, 0) | 1 << BIT[name]
    return masks


@lru_cache(maxsize=1)
def gates() -> list[int]:
    """Per voter the classes that a sentence must hold."""
    return [sum(1 << BIT[n] for n in v.needs) for v in VOTERS]


def votes(sentence: str) -> list[int]:
    """Every voter's vote on a sentence: its sign, or 0."""
    return [v.vote if p.search(sentence) else 0 for v, p in zip(VOTERS, compiled(), strict=True)]
