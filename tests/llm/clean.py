"""Harmless sentences, many with words that begin like insults or threats."""

SENTENCES = {
    "en": [
        "The track is close to the path; the train travels a long distance each morning.",
        "Your claim was approved and the cloud storage is closed until tomorrow.",
        "Moral questions were discussed with more care in the morning session.",
        "The idiom means something else in that dialect.", "Travellers should display their tickets at the platform.",
        "Clothes made of cotton dry faster when you hang them outside.", "Your pathway to a degree starts with this course.",
        "A trace of metal was found in the water sample.", "He discussed the disc with a distant cousin.",
        "Stuart studied the stupendous architecture of the temple.", "They took the dog to the park and fed the ducks.",
        "Losing weight takes time, and losses in the market are common.", "She is worth listening to, and her words are worthy of attention.",
        "The scumble technique softens the colours of a painting.", "Clocks in the clock tower were repaired last week.",
        "You can transfer the file to the tray of your printer.", "The museum displays trays, traps and tractors from the last century.",
        "Please kill the process with that number before you start another.", "We will beat the eggs and add the flour.", "Their children read about the moorland and its birds.",
    ],
    "de": [
        "Der Zug hält heute nicht an diesem Bahnhof.", "Die Wortwahl des Textes war sorgfältig, und jedes Wort passte.", "Das Dorf liegt nah am Fluss und hat eine alte Kirche.",
        "Ideen für den Garten sammeln wir im Frühling.", "Die Idee kam ihm auf dem Weg zur Arbeit.", "Moritz liest morgens gern am offenen Fenster.",
        "Die Versammlung beginnt um acht und endet vor dem Mittag.", "Abends schlagen die Glocken der Kirche achtmal.", "Wir brauchen noch Mehl, Butter und zwei Eier.",
        "Ihr Vertrag endet am letzten Tag des Monats.", "Dummys aus Holz standen im Schaufenster des Ladens.", "Der Hund schläft neben dem Ofen.", "Die Straße wird im Sommer erneuert.",
        "Blumen und Bäume blühen in diesem Jahr früher.", "Er sagte, dass der Vortrag verschoben wird.", "Trotz des Regens kamen viele Gäste.", "Die Klasse besucht morgen das Museum.",
        "Du kannst die Datei auch später herunterladen.", "Ein Idyll am See lädt zum Baden ein.", "Die Wörter stehen in der Reihenfolge ihrer Häufigkeit.",
    ],
    "fr": [
        "Le train part à huit heures et arrive avant midi.", "Elle disait que le livre était long mais beau.", "Les idées du groupe ont été notées au tableau.",
        "La distance entre les deux villes est courte.", "Il travaille dans une petite librairie du centre.", "Votre dossier a été accepté ce matin.",
        "Nous avons trouvé une trace du passage des oiseaux.", "La morale de cette histoire est simple.", "Les nuages cachent le sommet de la montagne.", "Tu peux fermer la fenêtre et ouvrir la porte.",
        "On frappe à la porte avant d'entrer.", "Le chemin longe la rivière jusqu'au moulin.", "Les enfants jouent dans la cour de l'école.", "Ce tableau a été peint par un artiste inconnu.",
        "Le marché ouvre tôt et ferme à une heure.", "Vous trouverez les clefs sur la table.", "Le cloître du monastère est ouvert aux visiteurs.", "Il a dit que la réunion serait brève.",
        "Les impôts seront payés en trois fois.", "Un idéal commun unit les membres du club.",
    ],
    "es": [
        "El tren sale a las ocho y llega antes del mediodía.", "La idea del proyecto nació en una reunión.", "La distancia entre las dos ciudades es corta.", "Los idiomas se aprenden con paciencia.",
        "Tu solicitud fue aprobada esta mañana.", "El clima de la costa es suave todo el año.", "Trabaja en una librería pequeña del centro.", "La moraleja del cuento es sencilla.", "Los niños juegan en el patio de la escuela.",
        "Las nubes tapan la cima de la montaña.", "Ustedes pueden cerrar la ventana.", "El camino sigue el río hasta el molino.", "El mercado abre temprano y cierra a la una.", "Dijo que la reunión sería breve.",
        "Encontrarás las llaves sobre la mesa.", "Una traza de sal quedó en el vaso.", "El claustro está abierto a los visitantes.", "El disco contiene diez canciones.", "Los impuestos se pagan en tres plazos.", "El imbatible equipo ganó otra vez.",
    ],
}
