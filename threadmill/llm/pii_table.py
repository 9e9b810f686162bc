"""The labelled table that the personal-information tagger is trained on.

Rows are made from public knowledge only: how telephone, identity and address
formats of various countries look, common given and family names, and everyday
sentences with and without personal data.  In formats, # stands for a digit,
A for a capital letter, X for either, and [abc] for one of these.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")
#: Digit words, for numbers that are spelled out.
WORD = "zero oh one two three four five six seven eight nine double".split()
#: Titles that make a family name a name.
TITLES = "mr mrs ms miss mx dr prof professor doctor sir madam lady herr frau mme mlle madame monsieur sr sra señor señora don doña signor signora".split()

#: Given names of various languages.
GIVEN = """
James Mary Robert Patricia John Linda Michael Barbara David Susan William Jessica Richard Sarah Thomas Karen Daniel Nancy Matthew Lisa Anthony Betty Paul Sandra Kevin Ashley Brian Emily
George Donna Edward Michelle Ronald Carol Timothy Amanda Jason Melissa Jeffrey Deborah Ryan Laura Gary Rebecca Nicholas Helen Eric Olivia Stephen Hannah Barack Angela Priya Wei Mohammed Fatima Ahmed Aisha Yusuf
Omar Leila Ali Zainab Hassan Noor Ivan Olga Dmitri Natasha Sergei Tatiana Boris Svetlana Piotr Agnieszka Zbigniew Jan Katarzyna Milan Jana Ondrej Petra Zoltan Ildiko Andras Erzsebet
Lars Ingrid Bjorn Astrid Sven Freya Mikkel Anders Eero Aino Hans Greta Jürgen Heike Klaus Sabine Uwe Ursula Stefan Monika Pierre Camille Jean Amélie Luc Chloé François Élodie Mathieu Margaux
Carlos Lucía Javier Carmen Diego Pilar Alejandro Beatriz Pablo Ana Miguel Rocío João Inês Rafael Thiago Giulia Marco Chiara Luca Francesca Matteo Hiroshi Yuki Kenji Sakura Haruto Min-jun Ji-woo Li Xiu
Anil Deepa Rajesh Sunita Arjun Kavya Chinedu Ngozi Kwame Ama Thabo Siobhan Liam Niamh Angus Rhys Seren Max Leo Zoe Mia Nina Tom Sam Kate Ben
""".split()
#: Family names of various languages.
FAMILY = """
Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker
Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Obama Merkel Patel Zhang Wang Chen Liu Singh Kumar Sharma
Gupta Khan Hussein Rahman Haddad Nasser Ivanov Petrova Sokolov Kuznetsova Kowalski Kowalczyk Nowak Wiśniewska Novák Dvořáková Horváth Szabó Popescu Ionescu Hansen Jensen Nilsson Lindqvist Virtanen Korhonen
Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Vogel Dupont Lefèvre Moreau Girard Bonnet Rousseau Fernández Jiménez Ortega Navarro Silva Pereira Almeida Costa Rossi Bianchi Romano
Tanaka Suzuki Yamamoto Kim Park Choi Okafor Adeyemi Mensah Dlamini Murphy Byrne MacDonald Fraser Evans Llewellyn Hughes Cooper Bailey Ward Foster Bennett Reid Vega Castillo
""".split()
#: Beginnings, middles and ends that further family, given and place names are made of.
ONSET = "b br c ch cl d dr f fr g gr h j k kl kr l m n p pr r s sch sh sk st t th tr v w y z".split()
NUCLEUS = "a e i o u ai ea ie oo au ö ü á é".split()
CODA = "l m n r s t nd rt ck ll ss nk x".split()
SURNAME_END = "son sen sson dottir ez es ski ska sky ov ova ev ic ić man mann er stein berg feld ini elli etti eau ault ois oğlu yan ian uk chuk wicz quist lund ström dahl nen iou idis ara eda".split()
PLACE_END = "ton ham ford burgh stad heim hausen dorf ville mont bourg holm by wick field port mouth grad ovo pura".split()

STREET = "Maple Oak Cedar Pine Elm Washington Lincoln Church Station Victoria Albert Mill Park River Lake Chestnut Sunset Highland Meadow Jackson King Queen Market Bridge College School Spring Garden Harbour North West".split()
SUFFIX = "Street St St. Road Rd Avenue Ave Ave. Lane Ln Drive Dr Court Ct Place Way Close Crescent Terrace Row Blvd Boulevard Square Gardens Hill Parkway Pkwy Mews".split()
CITIES = "London Leeds Bristol Springfield Portland Denver Boston Berlin Hamburg Köln Wien Zürich Paris Lyon Nantes Lille Madrid Sevilla Bilbao Milano Torino Dublin Cork Toronto Sydney Austin Glasgow Utrecht".split()

#: Telephone formats of various countries.
PHONES = """
###-###-####|(###) ###-####|(###)###-####|###.###.####|### ### ####|1-###-###-####|1###-###-####|1##########|+1 ### ### ####|+1-###-###-####|+1 (###) ###-####|+1##########|##########|(###) ### ####|###-####
+44 7### ######|+44 7### ### ###|+447#########|07### ######|07### ### ###|07#########|020 #### ####|+44 20 #### ####|0121 ### ####|01### ######|(01###) ######|+44 (0)20 #### ####|0044 7### ######
+49 30 ########|+49 171 #######|+49 (0)89 ######|+49 30 ##### ###|+49 ### #######|030/#######|030 ########|0171 #######|0171-#######|0176 ########|0049-30-########|0049 171 #######|089-######
+33 6 ## ## ## ##|+33 1 ## ## ## ##|+336########|+33### ######|+331########|06 ## ## ## ##|01 ## ## ## ##|06.##.##.##.##|06########|0033 6 ## ## ## ##
+34 6## ### ###|+34 91 ### ## ##|6## ### ###|6## ## ## ##|91 ### ## ##|+349########|+39 3## #######|+39 06 #### ####|3## #######|+31 6 ########|06-########|+41 79 ### ## ##|079 ### ## ##|+43 660 #######|+46 70 ### ## ##|070-### ## ##
+47 ### ## ###|+45 ## ## ## ##|+358 40 #######|+48 ### ### ###|+420 ### ### ###|+36 20 ### ####|+351 9## ### ###|+353 87 ### ####|+30 69# ### ####|+90 5## ### ## ##|+7 9## ###-##-##|8 (9##) ###-##-##
+55 11 9####-####|(11) 9####-####|+52 55 #### ####|+91 ##### #####|+91-##########|+86 1## #### ####|+81 3-####-####|+81 90 #### ####|03-####-####|+82 10-####-####|+61 4## ### ###|04## ### ###|+61 2 #### ####|+27 8# ### ####|+234 80# ### ####|+971 50 ### ####|+65 #### ####
""".replace("\n", "|").strip("|").split("|")
#: Identity numbers: what stands before them, and their formats.
IDS = {
    "SSN|social security number|my social is|social security no.|social|SSN:|ssn|soc sec": "###-##-####|### ## ####|#########|###-##-####",
    "NI number|national insurance number|nino|NI no.|insurance number": "AA ## ## ## [ABCD]|AA######[ABCD]|AA ###### [ABCD]",
    "passport|passport number|passport no.|passport no|Reisepass Nr.|numéro de passeport|pasaporte|pasaporte número|my passport is": "#########|A########|AA#######|AA# ### ###|C##X##X##|[CFGHJKLMNPRTVWXYZ]XXXXXXXX|[CFGHJKLMNPRTVWXYZ]#XXXX#XX#|[CFGHJK]XXXXXXX#|##AA#####|AAA######|A#######|AA ######",
    "tax ID|tax number|Steuer-ID|Steuernummer|tax file number|tax id is|numéro fiscal|NIF|TIN|Steueridentifikationsnummer": "## ### ### ###|###########|##/###/#####|### ### ###|9##-##-####|##-#######|#############|## ## ### ### ###",
    "id card|identity card|ID number|ID card no.|Personalausweis|Ausweisnummer|carte d'identité n°|national id|national ID number|identity number": "#########|A########|A#########|A#########|[LMNPRTVWXY]XXXXXXXX|[LMNPRTVWXYZ]##X##X##|########-[ABCDEF]|########A|A#######A|##########|############|###########|####-####-####|A##X####A|A#######",
    "DNI|NIE|documento|DNI:": "########A|########-A|X#######A|Y-#######-A|##.###.###-A",
    "driving licence|driver's license|driver's licence|licence number|license no.|permis de conduire|Führerschein|driving license number|DL": "A#######|A###-####-####|AAAAA######AA#AA|AAAAA#######AA#AA|AAAAA## ##### AA#AA|A############|AA######|########|B###XXXX###|########A|## #######",
    "numéro de sécurité sociale|sécu|social insurance number|SIN|BSN|PESEL|CPF|personnummer|AHV|Aadhaar|PAN|codice fiscale|TFN|NHS number|Versicherungsnummer": "1 ## ## ## ### ### ##|2###### ### ### ##|### ### ###|#########|###########|###.###.###-##|######-####|756.####.####.##|#### #### ####|AAAAA####A|AAAAAA##A##A###A|### ### ####|## ###### A ###",
}

DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January March April July August October December".split()
NOMEN = "Motor Drucker Kuchen Regler Bohrer Schrank Bahnhof Garten Speicher Schalter Kabel Teller Ofen Wagen Tisch Brief Rechner Hammer Faden Spiegel Deckel Kanal Vertrag Verlag Antrag Käse Boden".split()
NOUNS = """
battery bicycle blanket book bottle box bridge button cable cake camera candle carpet cat chair chart clock coat coffee column computer cooker cup curtain data desk diagram dog door draft drill editor engine fence file filter
flag floor folder fork frame game garden gear glass glue guitar hammer handle heater hinge hose invoice jacket kettle key keyboard kitchen knife ladder lamp layout leaf lesson letter lock log loop magazine manual map meeting menu metal
meter mirror model module monitor motor mouse needle network novel oven page paint paper pencil phone photo pipe plan plant plate plug pocket pump query queue radio recipe report ribbon ring roof room rope ruler sample sand saw
schedule screen screw seat sensor server shelf shirt shoe signal sink socket soup spring stamp stone switch system table tank tape test thread tile timer token tool track train tray tree tube valve version wheel window wire wood
""".split()
ADJECTIVES = "new old red small heavy empty loose wet broken quick simple odd blue quiet solid cheap strange narrow soft bright common proper gentle rough steep lazy digital wooden electric final second local public early".split()
VERBS = "fixed cleaned moved painted checked ordered replaced tested borrowed packed shipped dropped lost found opened closed printed reset updated compiled tuned welded weighed borrowed sketched sold".split()
#: What numbers count that are nobody's, and how such numbers are grouped.
COUNTED = "order ticket part serial invoice tracking case error block sector model build revision version lot batch reference claim item article asset port pin uid job run bug issue request receipt voucher parcel flight room row seat firmware commit drawing chip frame sensor".split()
GROUPS = "####|#####|######|#######|########|##########|############|###-####-###|####-##-####-###|####-####|##-####|###-###|#.##.###|#.#.#|A#######|AA######|AA-####|A##-###|##/####|#### ####|####-####-####|X###X##A|########-##|##-#####-#|0x########|### ###|#####-A".split("|")
LINKS = "the a to and is of in by with has for on as at my our was will from said if did about your and then or not but because who that when so still never always can would please what where".split()
#: Words before or after which two capital words are a thing, a place or a firm.
THING = "release kernel edition server chassis update branch model build series cluster prototype motherboard album chapter station bus ferry".split()
GEO = "Ridge Canyon Valley Creek Lake Forest Falls Harbor Beach Island Mountain Bay Peak River Point Heights Springs Glacier Meadow Summit Desert Bridge".split()
COLD = "Silent Red Blue Golden Magic Final Hidden Dark Super Good Open Hard Visual Little Big Real Deep Half White Black Free Second".split()
FIRM = "Systems Labs Works Software Electronics Motors Foods Records University Museum Hospital Airlines Press Institute Library Bank Group".split()

_FRAMES = {
    "email": ["email {}", "drop a line to {} please", "you can get me under {}", "cc {} on it", "forward the invoice to {}", "{} is the best address for questions", "contact: {}", "Send everything to {}, thanks", "my e-mail changed, it's {} now", "bitte an {} schicken", "écris-moi à {}", "escríbeme a {}", "mailto:{}", "<{}>", "{}", "not working? ask {} instead", "register with {}", "Reply-To: {}", "reach me ({})", "{} bounced again", "mail: {}", "I use {} for work", "anyone else locked out of {}?", "From: {}"],
    "phone": ["give me a ring on {}", "phone: {}", "{} is my mobile", "call me at {} tomorrow", "whatsapp {} works too", "tel. {}", "Tel: {}", "fax {}", "cell {}", "my number is {}", "dial {} and wait", "reach the office under {} before noon", "text {} when you arrive", "ruf mich an: {}", "appelle-moi au {}", "llámame al {}", "the desk answers on {} or by post", "{}", "({})", "new number {}, delete the other one", "Handy {}", "mobile {}, evenings only", "ring me {} after lunch", "on call this week: {}", "number: {}", "our number: {}", "the number here is {}", "just ring {} and ask", "or text {}", "try {} instead", "phone me, {}", "hotline: {} (free)", "if it rains call {}.", "leave a message on {}"],
    "id_number": ["{}", "my {} just in case", "they need the {} again", "put {} on the form", "here is the {}", "I typed {} and it was rejected", "{} expires in june", "use {} for the booking", "is {} still valid?", "customs asked for {}", "renew {} please", "{} was on the photo, please delete it", "Meine {}", "voici mon {}", "mi {}", "for the contract: {}", "wrote down {} by mistake", "{} and nothing else"],
    "address": ["we live at {}", "ship to {}", "send it to {} please", "the shop moved to {}", "come round to {} on friday", "I grew up at {}", "deliver to: {}", "{}", "my address is {}", "address: {}", "meet me in front of {}", "the party is at {}, bring a chair", "invoice goes to {}", "j'habite {}", "ich wohne in der {}", "vivo en {}", "old place was {}, dont use it", "return address {}", "pick it up from {} before six", "the package is still at {}.", "billing: {}", "next to {}"],
    "name": ["talk to {} about it", "{} told me so", "I met {} yesterday", "{} and I went home", "regards, {}", "signed {}", "Contact person: {}", "speak with {} first", "my landlord {} complained", "did {} reply yet?", "according to {} it works", "{} wrote the manual", "thank you {}", "a gift from {}", "the talk by {} was great", "{} is on holiday", "we hired {} last month", "call for {}", "name: {}", "my sister {} sings", "I am {}", "hi, I'm {} from support", "{} (accounting) will pay", "lent it to {} in may", "{}'s car is parked outside", "yours, {}", "frag mal {}", "demande à {}", "pregunta a {}", "from {} with love", "patient {} arrived", "{}, please come to the desk", "was it {} who left?", "{}", "{} - done", "next speaker: {}", "{} owes me one", "bought from {} for ten", "says {}", "written by {} in spring", "{} is right"],
    "author": ["@{} look at this", "hey {}, still there?", "{}: yes", "+1 to {}", "{} said it first", "as {} wrote above", "thanks {}", "(cc {})", "ping {}", "quoting {} here", "what {} means is simple", "{} lol", "hello {}!", "ty {}", "{} posted it", "reported by {}"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def fill(self, pattern: str) -> str:
        r = self.r
        out = re.sub(r"\[(\w+)\]", lambda m: r.choice(m[1]), pattern)
        some = {"#": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X": "0123456789CFGHJKLMNPRTVWXYZ"}
        return "".join(r.choice(some[c]) if c in some else c for c in out)

    def invented(self, ends: list[str], lo: int = 1, hi: int = 2) -> str:
        r = self.r
        body = "".join(r.choice(ONSET) + r.choice(NUCLEUS[: r.choice([5, 5, 5, 14])]) + (r.choice(CODA) if r.random() < 0.4 else "") for _ in range(r.randint(lo, hi)))
        return (body + (r.choice(ends) if ends else "")).capitalize()

    def family(self) -> str:
        r = self.r
        x = r.choice(FAMILY) if r.random() < 0.35 else self.invented(r.choice([SURNAME_END, SURNAME_END, []]))
        k = r.random()
        return f"{x}-{r.choice(FAMILY)}" if k < 0.04 else f"{r.choice(['von', 'van', 'de', 'del', 'de la', 'van der', 'bin', 'al', 'da'])} {x}" if k < 0.08 else f"{r.choice(['O’', 'Mc', chr(79) + chr(39)])}{x}" if k < 0.12 else x

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.75 else self.invented(["", "a", "o", "e", "us", "ine", "y"], 1, 2)

    def place(self) -> str:
        r = self.r
        return r.choice(CITIES) if r.random() < 0.3 else self.invented(PLACE_END)

    def handle(self) -> str:
        a, b = self.invented([], 1, 2), self.invented([], 1, 1)
        n = "".join(self.r.choice("0123456789") for _ in range(self.r.choice([0, 1, 2, 3, 4])))
        return self.r.choice([a + n, a.lower() + n, f"{a.lower()}_{b.lower()}{n}", f"{a}-{b.lower()}{n}", f"x{a.lower()}x", f"{a.lower()}.{b.lower()}", f"{a}{b}{n}", f"the_{a.lower()}"])

    def name(self) -> str:
        r, g, f = self.r, self.given(), self.family()
        i, j = r.choice("ABCDEFGHIJKLMNOPRSTUVWY"), r.choice("ABCDEFGHIJKLMNOPRSTUVWY")
        t = r.choice(TITLES).capitalize() + r.choice(["", "", "."])
        x = r.choice([f"{g} {f}"] * 9 + [f"{f}, {g}"] * 3 + [f"{t} {f}"] * 4 + [f"{g} {i}. {f}", f"{g} {i} {f}", f"{i}. {f}", f"{i}. {f}", f"{i} {f}", f"{i}. {j}. {f}", f"{i}.{j}. {f}", f"{t} {f}", f"{t} {f}", f"{t} {f}", f"{t} {g} {f}", f"{t} {i}. {f}", f"{f}, {i}.", f"{g} {self.given()} {f}", f"{g} {f} Jr.", f"{g} {f} {r.choice(FAMILY)}", f"Dr. {r.choice(['med.', 'h.c.', 'Dr.'])} {g} {f}"])
        return r.choice([x] * 6 + [x.upper(), x.lower(), x.lower()])

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.family().lower().replace(" ", "").replace("’", "").replace("'", "")
        n = str(r.randrange(1, 2000))
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g}{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{g}{n}", f"{f}{n}", g, f, f"{f}.{g}", f"{f}_{g}", f"{g}.{f}+{r.choice(NOUNS)}", f"{f}+{r.choice(['news', 'lists', 'spam'])}", r.choice(["info", "sales", "support", "no-reply", "kontakt"]), f"{g}.{f}{n}", f"{g[0]}{f}{n}"])
        host = r.choice([self.invented([]).lower(), f"{r.choice(NOUNS)}{r.choice(['', 's', '-online', 'mail', 'works', 'lab', 'net'])}", f"uni-{self.place().lower()}", f"mail.{self.invented([]).lower()}", f"{self.invented([]).lower()}-{r.choice(['co', 'it', 'web'])}", r.choice(["gmail", "outlook", "web", "gmx", "yahoo", "proton"])])
        tld = r.choice("com com com org net edu de fr es it nl eu io dev info me ch at pl se co.uk ac.uk com.au gov example test invalid co example.org".split())
        k = r.randrange(12)
        if k == 0:
            return f"{local}{" @ "}{host}.{tld}"
        if k in (1, 2, 3):
            at = r.choice([" at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " {at} "])
            dot = r.choice([".", " dot ", "(dot)", "[dot]", " [dot] ", " DOT "]) if at.strip().lower() != "at" else r.choice([" dot ", " DOT "])
            return (local.replace(".", dot) if r.random() < 0.5 else local) + at + host.replace(".", dot) + dot + tld.replace(".", dot)
        x = f"{local}@{host}.{tld}"
        return x.upper() if k == 4 else f"{local.title()}@{host}.{tld}" if k == 5 else x

    def phone(self) -> str:
        r = self.r
        if r.random() < 0.1:
            say = lambda k: " ".join(r.choice(WORD) for _ in range(k))
            return r.choice([f"{say(3)} {say(4)}", f"{say(3)}, {say(4)}", f"{say(3)}, {say(3)}, {say(4)}", say(7), say(10), f"{say(3)}, {say(2)} {say(2)}", f"{say(3)} - {say(4)}"])
        x = self.fill(r.choice(PHONES))
        return x + r.choice([" ext. ", " x", " ext "]) + str(r.randrange(10, 999)) if r.random() < 0.03 else x

    def id_number(self) -> tuple[str, str]:
        """What stands before the number, and the number."""
        r = self.r
        cues, formats = r.choice(list(IDS.items()))
        cue, number = r.choice(cues.split("|")), self.fill(r.choice(formats.split("|")))
        cue = r.choice([cue, cue, cue, cue.lower(), cue.upper()])
        sep = r.choice([" ", " ", " ", ": ", ":", " is ", " # ", " = "])
        if r.random() < 0.08:
            number = number.lower()
        return cue + sep, number

    def address(self) -> str:
        r, d = self.r, self.fill
        n, p = str(r.randint(1, 299)) + r.choice(["", "", "", "", "a", "b", "c", "-3"]), self.place()
        s = r.choice(STREET) if r.random() < 0.5 else self.invented(r.choice([[], ["wood", "field", "well", "dale"]]))
        x = s.lower()
        g = r.choice(["straße", "str.", "strasse", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer"])
        v = r.choice(["rue", "avenue", "boulevard", "place", "allée", "chemin", "impasse", "quai", "cours"])
        c = r.choice(["Calle", "Avenida", "Plaza", "Paseo", "C/", "Avda.", "Carrer", "Via", "Corso", "Rua"])
        end = r.choice(["", "", f", {p}", f", {p}", f" in {p}", f", {p} {d('#####')}", f", {p}, {d('AA')} {d('#####')}", f", {p} {d('AA# #AA')}", f", {p}, {d('A# #AA')}"])
        de, fr = r.choice(["", f", {d('#####')} {p}", f", {d('#####')} {p}", f" in {p}"]), r.choice(["", f", {d('#####')} {p}", f", {p}", f" à {p}"])
        unit = r.choice([f"Flat {r.randint(1, 60)}", f"Apt {r.randint(1, 40)}{r.choice('ABC')}", f"Apt. {r.randint(1, 40)}", f"Unit {r.randint(1, 99)}", f"Suite {r.randint(100, 900)}", f"Room {r.randint(1, 99)}"])
        box = r.choice(["PO Box", "P.O. Box", "P.O.Box", "Post Office Box", "Postfach", "BP", "Apartado", "Apdo.", "Box", "po box"])
        near = r.choice(["", "", "", "N ", "W ", "East ", "S. "])
        return r.choice(
            [f"{n} {near}{s} {r.choice(SUFFIX)}{end}"] * 5
            + [f"{unit}, {n} {near}{s} {r.choice(SUFFIX)}{end}", f"{n} {near}{s} {r.choice(SUFFIX)}, {unit}{end}", f"{n} {near}{s} {r.choice(SUFFIX)} {unit}{end}", *([f"{n} {x} {r.choice(SUFFIX).lower()}{end}"] * 4), f"{s} {r.choice(SUFFIX)} {n}{end}", f"{s} {r.choice(SUFFIX)} {n}{end}"]
            + [f"{s}{g} {n}{de}"] * 2 + [f"{r.choice(['Am', 'Im', 'An der', 'Auf dem', 'Zum'])} {s} {n}{de}", f"{s.lower()}{g} {n}{de}"]
            + [f"{n}{r.choice([',', '', ' bis,', ' ter,'])} {v} {r.choice(['', 'de ', 'du ', 'de la ', 'des '])}{s}{fr}"] * 2
            + [f"{c} {s} {n}{r.choice(['', f', {r.randint(1, 9)}º {r.choice(chr(65) + chr(66) + chr(67))}', f', piso {r.randint(1, 9)}', f', {r.randint(1, 9)}º'])}{fr}"] * 2
            + [f"{box} {r.randint(10, 9999)}{end}"] * 2
        )

    def thing(self) -> str:
        r = self.r
        return f"{r.choice(NOUNS)} {r.choice(NOUNS)}" if r.random() < 0.35 else r.choice(NOUNS)

    def plain(self) -> str:
        """A sentence without personal data, often with numbers, places, machines or dates in it."""
        r, n = self.r, self.r.randint(2, 90)
        a, b, t, u, v, p = r.choice(ADJECTIVES), r.choice(ADJECTIVES), self.thing(), self.thing(), r.choice(VERBS), self.place()
        m, q = f"{self.invented([], 1, 3)} {r.choice([n * 10, n, f'{n}x', 'II', 'Pro'])}", self.place()
        x = r.choice([
            f"The {a} {t} was {v} before lunch.", f"I {v} the {t} and now the {u} is {a}.", f"why does my {t} need a {a} {u}?", f"anyone selling a {a} {t}?", f"We took the bus from {p} to {q} with {n} people.", f"{p} is lovely in winter.", f"Greetings from {p}!", f"in {p} they {v} every {t}", f"a {m} runs hot with the {a} {t}", f"The {m} has {n} {t}s and a {b} {u}.", f"{m} or an {a} {t}, what would you take?",
            f"Nothing beats a {a} {t}.", f"good night all", f"Morning everyone, coffee is ready", f"haha no way", f"brb in {n} min", f"Nice one, thanks!", f"It cost {n} euros in {p}, half of that in {q}.", f"After {n} days the {t} finally {v} itself.", f"{t.capitalize()} first, {u} later.", f"Read the {t} chapter, it explains {u} well.", f"Has the {t} been {v}? The {u} looks {a}.", f"No {t}, no {u}. Simple.",
            f"Der {r.choice(['Motor', 'Drucker', 'Kuchen', 'Film', 'Regler'])} aus {p} ist {r.choice(['laut', 'neu', 'kaputt', 'fertig'])}.", f"Ich habe {n} {r.choice(['Schrauben', 'Bilder', 'Karten', 'Kabel'])} in {p} gekauft.", f"Ohne {r.choice(['Werkzeug', 'Strom', 'Netz'])} geht {r.choice(['Bohrer', 'Lampe', 'Rechner'])} nicht.", f"Nach {n} Wochen war der {r.choice(['Schrank', 'Zug', 'Text'])} aus {p} da.", f"Le {r.choice(['moteur', 'jardin', 'livre', 'train'])} de {p} est {r.choice(['petit', 'vieux', 'lent'])}.", f"On a vu {n} {r.choice(['bateaux', 'films', 'lettres'])} à {p}, c'était bien.", f"Sans {r.choice(['sel', 'lumière', 'clé'])} pas de {r.choice(['pain', 'photo', 'porte'])}.", f"El {r.choice(['motor', 'libro', 'tren', 'vino'])} de {p} es {r.choice(['viejo', 'bueno', 'lento'])}.", f"Compramos {n} {r.choice(['sillas', 'cables', 'fotos'])} en {p} y nada más.", f"Alguien trajo {r.choice(['pan', 'cinta', 'agua'])} desde {p}.", f"Bonjour à tous", f"Guten Morgen zusammen", f"Buenos días a todos",
            f"The {p} {t} club {v} its {u} again.", f"people from {p} say the {t} is {a}", f"Every {t} in {p} has {n} {u}s.", f"Our {m} {t} came back from {p} {v} and {a}.", f"{p} won {n % 7}:{n % 5} against {q}.", f"Between {p} and {q} the road is {a}.", f"Is the {m} manual online?", f"On {r.choice(DAYS)} {p} opened its {t}.", f"Since {r.choice(DAYS)} {p} is {a}.", f"{r.choice(['Maybe', 'Honestly', 'Actually', 'Sometimes', 'Once', 'Surely', 'Perhaps', 'Still', 'Yes', 'No'])} {p} has a {t}.", f"{r.choice(['Honestly', 'Actually', 'Recently', 'A', 'The', 'Any', 'Most', 'Some', 'My', 'Your', 'This'])} {t} was {v}.",
            f"Warum ist {r.choice(NOMEN)} so {r.choice(['teuer', 'alt', 'laut'])}?", f"Der {r.choice(NOMEN)} und der {r.choice(NOMEN)} aus {p} sind weg.", f"Jeder {r.choice(NOMEN)} braucht {r.choice(NOMEN)}.", f"Erst {r.choice(NOMEN)}, dann {r.choice(NOMEN)} und {r.choice(NOMEN)}.", f"{r.choice(NOMEN)} in {p}, {n} Euro.", f"Je pars dans {n} jours.", f"Vuelvo en {n} horas.", f"Bin in {n} Minuten da.", f"Take {n} {a} {t}s along.", f"Keep calm and drink {t}.", f"Il reste {n} places à {p}.", f"update: {t} {v}, {u} still {a}", f"half the {t}s I {v} in {p} were {a}", f"{r.choice(['Monday', 'Tuesday', 'Friday', 'Sunday'])} is {t} day in {p}.", f"[edited] {t} {v}", f"They {v} {n} {a} {t}s, then {b} ones.", f"One {r.choice(['summer', 'winter', 'week', 'year'])} in {p} was enough for a {a} {t}.", f"In {p} the {t} is {a}, says everyone.", f"It was {v}.", f"{t}, {u}, {r.choice(NOUNS)}: all {a}",
        ])
        return r.choice([x] * 5 + [x.lower()])

    def decoy(self) -> str:
        """Numbers and names that are nobody's."""
        r, d = self.r, self.fill
        w, p = self.invented([], 1, 2), self.place()
        x = r.choice([
            *(f"{r.choice([c, c, c.capitalize()])} {r.choice(['', '', 'no. ', 'number ', '# ', 'id ', 'nr '])}{self.fill(r.choice(GROUPS))} {r.choice(['', '', 'is done', 'came back', 'failed', 'arrived', 'please', 'again'])}".strip() for c in [r.choice(COUNTED), r.choice(COUNTED), r.choice(COUNTED), r.choice(COUNTED)] * 5),
            *(f"{a} {r.choice([r.choice(SUFFIX).lower(), r.choice(NOUNS)])} {b}" for a, b in [("a", f"near {p}"), (str(r.randint(2, 90)), f"of {r.randint(2, 9)}"), ("the", f"{r.randint(1, 9)} of {r.randint(1, 9)}"), ("every", f"has {r.randint(2, 90)} {r.choice(NOUNS)}s"), (f"{w} {r.randint(1, 99)}0 and the {r.choice(NOUNS)}", f"by {p}"), (f"{r.choice(NOUNS)}", f"{r.randint(1, 20)}"), (f"{r.randint(2, 90)} {r.choice([*NOUNS, *ADJECTIVES])}", f"{r.choice(NOUNS)}s"), ("one", f"less than {r.randint(2, 30)} {r.choice(ADJECTIVES)} ones")] * 2),
            d("order ############ left the depot"), d("ticket #### is closed"), d("invoice no. ########"), d("tracking [12]Z###A##########"), d("tracking number ####-####-####"), d("error 0x########"), d("error code ######"), d("v#.##.###"), d("firmware #.##.### is out"), d("part no. ###-####-###"), d("serial A#######"), d("serial no. AA######"), d("serial number ########## on the back"), d("SKU A##-####"), d("model AA-####X"), d("isbn 978-#-###-#####-#"),
            f"on 20{d('##')}-{d('[01]#')}-{d('[012]#')} at {d('##:##')}", d("[12]#.[01]#.20## ##:##"), d("log ####-##-## ##:##:##"), d("ip ###.##.#.##"), d("ping 10.#.##.###"), d("the host 192.168.#.## is down"), d("mac ##:##:0A:##:##:##"), d("sector ########"), d("uid #########"), d("commit ########a"), d("GPS ##.#####, -##.#####"), d("price went from #### to ###.##"), d("total ##,###.## eur"), d("##### views, ### likes"), d("population #,###,###"), d("res. ####x####"), d("#### rpm at ## volts"), d("## of ### done"), d("pin ## to ground"), d("pages ###-###"), d("score ##-##"),
            d("rack ##, second shelf"), d("reference ##-####-####-##"), d("request ####/##/###"), d("crate ## by the north wall"), d("room ### has no window"), d("row ##, seat #"), d("road works on the A##"), d("platform ## today"), d("gate A## is open"), d("court # is wet"), d("box ## of ##"), d("place ## of ###"), d("address 0x####"), d("## way valve"), d("## north, ## west"),
            f"the {w} {r.choice(GEO)} {r.choice(THING)}", f"our {w} {r.choice(GEO)} {r.choice(THING)} crashed", f"{w} {r.choice(GEO)} is a nice {r.choice(THING)}", f"the {r.choice(STREET)} {r.choice(GEO)} {r.choice(THING)}", f"hiking at {w} {r.choice(GEO)}", f"{w} {r.choice(FIRM)} raised prices", f"works at {w} {r.choice(FIRM)}", f"the {w} {r.choice(FIRM)} logo", f"{p} {r.choice(FIRM)} opens late", f"{p} {r.choice(['Station', 'Airport', 'United', 'City'])}", f"{r.choice(['New', 'Los', 'San', 'Santa', 'Saint', 'El', 'La', 'Las', 'North', 'South', 'East', 'West', 'Great', 'Old', 'Upper'])} {p} is far", f"I like {r.choice(['New', 'San', 'South', 'Le', 'North'])} {w}", f"{w} {r.choice(GEO)}, {r.choice(['anyone?', 'wow', 'nice'])}", f"{r.choice(COLD)} {r.choice(NOUNS).capitalize()} is on tv", f"{r.choice(COLD)} {r.choice(GEO)} level three", f"the {r.choice(COLD)} {r.choice(NOUNS).capitalize()} {r.choice(THING)}", f"{r.choice(NOUNS).capitalize()} {r.choice(NOUNS).capitalize()} {d('#')}", d("git show ") + "".join(r.choice("0123456789abcdef") for _ in range(40)), d("serial number A########AA"), d("checksum ") + "".join(r.choice("0123456789abcdef") for _ in range(16)), f"room {d('##')} please", f"Mount {w}", f"Lake {w}", f"Port {w}", f"the {w} {r.choice(THING)}", f"{w} {r.choice(THING)} {d('##')}", f"Happy New Year {p}!", f"{r.choice(['Red', 'Blue', 'Golden', 'Silent', 'Magic'])} {r.choice(['Dragon', 'Garden', 'Mountain', 'Engine', 'Tiger'])} is a good game",
            f"root@{w.lower()}:~# ls", f"{r.choice(['root', 'admin', 'pi', w.lower()])}@{w.lower()}:~$ make", f"ssh {w.lower()}@localhost", f"{w.lower()}@{w.lower()} died", f"scp a b@{w.lower()}:/tmp", f"@{r.choice(NOUNS)}.txt", f"https://{w.lower()}.{r.choice(['com', 'example', 'org'])}/{r.choice(NOUNS)}/{d('###')}", f"http://www.{w.lower()}.de/?id={d('########')}", f"/usr/lib/{w.lower()}/{r.choice(NOUNS)}.so", f"C:\\{w}\\{r.choice(NOUNS)}.ini", f"```{r.choice(NOUNS)} --{r.choice(NOUNS)}```", f"`{w.lower()}_{r.choice(NOUNS)}()`", f"#include <{r.choice(NOUNS)}.h>", f"meet at {p} at {d('#')} dot sharp", f"look at the {r.choice(NOUNS)} dot on the {r.choice(NOUNS)}", f"build {d('####')} of {w} {d('##0')}", f"{w} {d('###')} vs {w} {d('##0')}", f"channel #{r.choice(NOUNS)}-{r.choice(NOUNS)}", "one two three testing", f"{r.choice(WORD[2:])} or {r.choice(WORD[2:])} of them", f"passport photos cost {d('##')}", f"my passport expired in {d('20##')}", f"tax went up {d('##')} percent", f"the phone has {d('###')} GB", f"call of duty {d('#')}", "call me maybe", f"email is down since {d('##:##')}",
        ])
        return r.choice([x] * 6 + [x.lower()])

    def find(self) -> tuple[list[tuple[str, str | None]], bool]:
        """A sentence in parts (text, kind or None); whether its name is a known author."""
        r = self.r
        kind = r.choice([*KINDS, "phone", "phone", "id_number", "name", "name", "name", "author"])
        # Frames of words that nothing is known of: a find anywhere inside another sentence.
        words = self.plain().split(" ")
        at = r.randrange(len(words) + 1)
        inside = " ".join([*words[:at], "{}", *words[at:]])
        loose = " ".join(r.choice([*NOUNS, *ADJECTIVES, *VERBS, *LINKS]) for _ in range(r.randint(0, 4)))
        frame = r.choice([*_FRAMES[kind]] * 2 + [inside] * (2 * len(_FRAMES[kind])) + [f"{loose} {{}} {r.choice(LINKS)} {r.choice(NOUNS)}".strip()] * len(_FRAMES[kind]))
        if r.random() < 0.2:
            frame = frame.lower() if r.random() < 0.5 else frame[:1].upper() + frame[1:]
        a, b = frame.split("{}", 1)
        b = b.replace("{}", "it")
        if kind == "id_number":
            cue, number = self.id_number()
            return [(a + cue, None), (number, kind), (b, None)], False
        if kind == "author":
            x = self.handle() if r.random() < 0.8 else f"{self.given()} {self.family()}"
            return [(a, None), (r.choice([x, x, x.upper(), x.lower()]), "name"), (b, None)], True
        return [(a, None), (getattr(self, kind)(), kind), (b, None)], False

    def row(self) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
        """A text, its spans (from, to, kind), and the spans that are names of known authors."""
        r = self.r
        parts: list[tuple[list[tuple[str, str | None]], bool]] = []
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            parts.append(self.find() if r.random() < 0.72 else ([(self.decoy(), None)], False))
        for _ in range(r.choice([0, 1, 1, 2])):
            parts.insert(r.randrange(len(parts) + 1), ([(self.plain(), None)], False))
        text, spans, known = "", [], []
        for i, (seq, author) in enumerate(parts):
            if i:
                text += r.choice([" ", " ", ". ", ", ", "\n", "\n> ", " - ", "; ", " / "])
            for s, kind in seq:
                if kind:
                    spans.append((len(text), len(text) + len(s), kind))
                    if author or kind == "name" and r.random() < 0.15:
                        known.append((len(text), len(text) + len(s)))
                text += s
        return text, spans, known


def labelled_rows(n: int = 12000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]]:
    m = Maker(seed)
    return [m.row() for _ in range(n)]
