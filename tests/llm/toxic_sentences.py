"""Sentences in four languages, written apart from the voters and from every table, to measure recall and precision on."""

ABUSIVE = {
    "en": """You absolute muppet, learn to read before you open your mouth.
 Honestly you are the dumbest person this company has ever paid.
 Nobody would even notice if you vanished tomorrow, you waste of space.
 Shut your filthy trap, you miserable cow.
 I swear I will cave your skull in when I catch you.
 Say that again and I'll put a bullet in you.
 I hope your plane goes down and you burn with it.
 We know which school your kids go to, so think twice.
 You should just hang yourself and spare us all.
 Get out of my sight, you disgusting little freak.
 All Muslims are terrorists and should be thrown out of the country.
 Gypsies are thieving scum, every last one of them.
 Women are too stupid to be trusted with machines.
 Those refugees are like cockroaches crawling over our city.
 Gays should be shot, simple as that.
 We ought to gas the lot of these foreigners.
 Black people are inferior and belong in the fields.
 He slid his fingers inside her while she moaned his name.
 Show me your tits on camera, baby.
 I want to lick your pussy all night long.
 She sucked his cock until he came in her mouth.
 Hot horny housewives waiting for you, click for free porn.
 Take off your panties and spread your legs for me.
 Go fuck yourself, you lying piece of shit.""",
    "de": """Du bist echt zu blöd, um eine Tür aufzumachen.
 Halt die Klappe, du widerliche Kröte.
 Ich schlage dir den Schädel ein, wenn du noch einmal anrufst.
 Hoffentlich verreckst du bald, du Stück Dreck.
 Alle Ausländer sind Verbrecher und gehören abgeschoben.
 Juden sind Ungeziefer und müssen verschwinden.
 Schwule sind krank und sollten weggesperrt werden.
 Zeig mir deine Titten, du geile Sau.
 Er steckte seinen Schwanz tief in sie hinein.
 Leck mich am Arsch, du Penner.""",
    "fr": """Tu es vraiment trop bête pour comprendre quoi que ce soit.
 Ferme-la, espèce de gros porc.
 Je vais te défoncer la tête si tu reviens.
 J'espère que tu vas crever seul, ordure.
 Les Arabes sont des voleurs, il faut les expulser.
 Les homosexuels sont des malades qu'on devrait enfermer.
 Ces migrants sont des parasites, dehors.
 Montre-moi tes seins, salope.
 Il lui écarta les cuisses et la pénétra brutalement.
 Va te faire foutre, connard.""",
    "es": """Eres tan tonto que das pena.
 Cierra la boca, cerdo asqueroso.
 Te voy a romper las piernas si vuelves por aquí.
 Ojalá te mueras, hijo de puta.
 Los moros son unos ladrones y hay que expulsarlos.
 Las mujeres son inferiores y no deberían votar.
 Esos inmigrantes son ratas, que se larguen.
 Enséñame las tetas, zorra.
 Le metió la polla hasta que ella gritó de placer.
 Vete a tomar por culo, imbécil.""",
}
CLEAN = {
    "en": """You should read the manual before you open the housing.
 The muppet show starts at eight and children are welcome.
 Nobody noticed the leak until the pressure had dropped.
 Please shut the valve and lock the cabinet when you leave.
 He was hit on the head by a falling beam and taken to hospital.
 The guide explains how to put a bullet point in front of each line.
 I hope you feel better and that the flight goes smoothly.
 We know which schools take part in the survey.
 Hang the coat yourself and take a seat in the second row.
 The freak storm tore the roof off two barns.
 Muslims and Christians share the prayer room on the third floor.
 Cockroaches were found in the kitchen, so the canteen was closed.
 Women who operate the machines receive the same pay as men.
 The refugees were shown how to fill in the form.
 The bird reserve counts great tits and blue tits each spring.
 The foreign workers belong to the same union.
 Slide the bearing inside the sleeve until it clicks.
 The patient reported pain in the left breast after surgery.
 The rooster crowed while the cow was milked.
 I am so stupid, I left my badge at home again.
 This stupid printer has jammed for the third time today.
 The court heard that he had threatened to kill his neighbour.
 The word bitch means a female dog in a breeder's records.
 Strip the wire, then screw the nut onto the male thread.""",
    "de": """Du bist herzlich eingeladen, die Tür steht offen.
 Die Kröte überquert im Frühjahr die Straße zum Teich.
 Der Schlag beschädigte den Deckel der Pumpe.
 Hoffentlich erholst du dich bald wieder.
 Ausländer erhalten das Formular am Schalter drei.
 Das Museum zeigt die Geschichte der Juden in der Stadt.
 Die Richtlinie verbietet Beleidigungen und Drohungen.
 Ich bin so blöd, ich habe den Schlüssel vergessen.
 Das verdammte Programm stürzt ständig ab.
 Die Patientin wurde an der Brust untersucht.""",
    "fr": """Tu es invité à la réunion de mardi matin.
 Ferme la vanne avant de changer le joint.
 Le porc est servi avec une sauce à la moutarde.
 J'espère que tu vas bien et que le voyage sera agréable.
 Les étrangers reçoivent un dépliant en arabe et en anglais.
 Le règlement interdit les insultes et les menaces.
 Je suis trop bête, j'ai oublié mes clés.
 Les femmes peuvent passer un dépistage du cancer du sein.
 Cette fichue imprimante ne marche pas.
 Les migrants sont accueillis au centre jusqu'au printemps.""",
    "es": """Eres bienvenido a la reunión del martes.
 Cierra la boca del tanque antes de llenarlo.
 El cerdo se sirve con patatas y ensalada.
 Ojalá te mejores pronto y puedas volver.
 Los inmigrantes reciben el folleto en tres idiomas.
 El reglamento prohíbe los insultos y las amenazas.
 Soy tan tonto que olvidé la contraseña.
 Las mujeres pueden pedir una revisión de mama.
 Esta maldita aplicación no funciona.
 Las ratas dañaron el cable del sótano.""",
}


def lines(sentences: dict[str, str]) -> list[tuple[str, str]]:
    return [(lang, x.strip()) for lang, block in sentences.items() for x in block.split("\n")]
