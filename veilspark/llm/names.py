"""First names by gender, and words around names, in English and German texts."""

FEMALE = """
Agnes Amelie Anna Annika Barbara Bettina Birte Carla Celia Charlotte Claudia Delia Edda Elif Emma Eva Fatima Flora
Freya Greta Hanna Hannah Hedda Helga Ingrid Irina Jana Joana Judit Julia Karin Katja Käthe Laura Lea Lena Leonie
Linnea Lorena Lucia Mara Maria Marie Mia Mirja Monika Nadia Naila Nele Nina Noemi Nuria Olga Ottilie Pauline Petra
Philippa Renate Renée Ronja Rosa Sabine Sarah Selma Sigrid Sofia Sophie Svenja Tamsin Thea Ulrike Ursula Vera
Violeta Wanda Xenia Ylva Zeynep Zoë
""".split()
MALE = """
Alban Alexander Andreas Anton Bastian Benno Björn Bruno Christian Connor Cosmo Daniel Dario David Dilan Dorian Emre
Enno Fabian Farid Felix Frank Gideon Goran Hans Henrik Hugo Ilias Ivo Jakob James Jan Jasper John Jonas Jordan Jörg
Kasper Kenji Kilian Klaus Kuno Leon Levin Lukas Magnus Marek Martin Matthis Max Michael Milan Mohammed Orson Oskar
Paul Pavel Peter Quentin Rafik Robert Rupert Samir Silvio Stefan Thomas Tim Tobias Ugo Urban Walter Wenzel Wolfgang
Yannick Yusuf Zoran
""".split()
PARTICLES = ("van der", "van den", "von der", "de la", "von", "van", "zu", "zur", "zum", "de", "del", "della", "der", "di", "da", "du", "la", "le", "ten", "ter")
TITLES = ("Ms", "Mr", "Mrs", "Frau", "Herr", "Herrn", "Dr.", "Prof.")
LABELS = ("Contact", "Ansprechpartner", "Ansprechpartnerin", "Minutes taken by", "Protokoll", "Requested by", "Beantragt von", "handled by", "bearbeitet", "bearbeitet von", "cc", "Kopie an", "re", "Betr.", "Employee", "Mitarbeiter", "Mitarbeiterin", "From", "Von", "Reviewed and signed", "Geprüft und gezeichnet")
COMPANIES = ("ag", "se", "gmbh", "ltd", "kg", "systems", "logistics", "partners", "inc", "llc", "group", "co")
#: Words that stand after a name and aren't part of it.
AFTER = frozenset(
    "about abends agreed am an and anrufen ask asked at auf aus bat bei bis bitte by copied der die durch ein eine einigten er evenings for fragen für geplant handed has hat have he hinterließ im in is ist krank mit noch of on or over prüfte reported said says schrieb senden she sick signed the to über um und under unter unterschrieben until von wants war waren was weiterleiten were will wird with wurde zu zum zur".split()
)
