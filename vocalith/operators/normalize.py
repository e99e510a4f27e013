"""Numbers, dates, times, amounts, units, codes and symbols of a corpus as spoken words, with the hits of every rule.

An ordered rewrite system in SQL functions. A rule has a core pattern, what must stand before and after it, and a rendering. What it
matches becomes *atoms*: a kind, and its text spelled in a private alphabet, which no later rule can match; so each class
is masked for those that follow it. When all rules have run, each atom is said once, by its kind: number words come from a table of
one hundred by division. Rules fold over an array of rule numbers, so a row's text passes through them in one expression.

Only the neighbourhood of tokens that a rule could match is rewritten: prose between is carried past the rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vocalith.functions.text import unused

# Hindi number words from 0 to 99.
UNDER_100 = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस "
    "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस "
    "पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस "
    "सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ साठ "
    "इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर "
    "पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी "
    "अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
)
# Words of the scale, months, letters, English digits, ordinals, fractions, parts of the day, units, marks and domains.
HUNDRED, THOUSAND, LAKH, CRORE = "सौ", "हज़ार", "लाख", "करोड़"
MONTHS = "जनवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर"
LETTERS = "ए,बी,सी,डी,ई,एफ,जी,एच,आई,जे,के,एल,एम,एन,ओ,पी,क्यू,आर,एस,टी,यू,वी,डब्ल्यू,एक्स,वाई,ज़ेड"
ENGLISH_DIGITS = "ज़ीरो वन टू थ्री फ़ोर फ़ाइव सिक्स सेवन एट नाइन"
ORDINALS = {"1": "पहला", "2": "दूसरा", "3": "तीसरा", "4": "चौथा", "5": "पाँचवाँ", "6": "छठा"}
FRACTIONS = {"1/2": "आधा", "1/4": "एक चौथाई", "3/4": "तीन चौथाई"}
DAY_PARTS = "सुबह|सवेरे|दोपहर|शाम|रात"
SCALES = {"lakh": LAKH, "lac": LAKH, "crore": CRORE, "cr": CRORE, "k": THOUSAND, "लाख": LAKH, "करोड़": CRORE, "हज़ार": THOUSAND, "हजार": THOUSAND}
UNITS = {
    "km": "किलोमीटर", "kg": "किलो", "g": "ग्राम", "gm": "ग्राम", "ml": "मिलीलीटर", "l": "लीटर", "ltr": "लीटर", "gb": "जीबी", "mb": "एमबी", "min": "मिनट", "mins": "मिनट",
    "hr": "घंटे", "hrs": "घंटे", "sec": "सेकंड", "km/h": "किलोमीटर प्रति घंटा", "kmph": "किलोमीटर प्रति घंटा",
}
WEB_MARKS = {"@": "एट", ".": "डॉट", "_": "अंडरस्कोर", "-": "डैश", "+": "प्लस", "/": "स्लैश", "?": "क्वेश्चन मार्क", "=": "बराबर", "&": "एंड", "#": "हैश", "%": "परसेंट", ":": "कोलन", "~": "टिल्ड"}
DOMAINS = {"com": "कॉम", "org": "ऑर्ग", "net": "नेट", "in": "इन", "co": "को", "io": "आई ओ", "gov": "गव", "edu": "एडू", "info": "इन्फ़ो", "app": "ऐप", "nic": "एन आई सी", "ac": "ए सी"}
# Abbreviations and how they are said.
SAID = {
    "डॉ.": "डॉक्टर", "श्री.": "श्री", "कि.मी.": "किलोमीटर", "किमी": "किलोमीटर", "Dr.": "डॉक्टर", "Mr.": "मिस्टर", "Mrs.": "मिसेज़", "Rs.": "रुपये", "Rs": "रुपये", "km": "किलोमीटर", "kg": "किलो",
    "EMI": "ई एम आई", "24/7": "चौबीसों घंटे", "24x7": "चौबीसों घंटे", "OTP": "ओ टी पी", "KYC": "के वाई सी", "Ltd.": "लिमिटेड", "Pvt.": "प्राइवेट", "No.": "नंबर", "UPI": "यू पी आई", "SMS": "एस एम एस", "PIN": "पिन",
    "AI": "ए आई", "FAQ": "एफ ए क्यू", "GST": "जी एस टी", "PAN": "पैन", "SIM": "सिम", "ATM": "ए टी एम", "IFSC": "आई एफ एस सी", "CVV": "सी वी वी", "IVR": "आई वी आर", "API": "ए पी आई", "URL": "यू आर एल",
    "PDF": "पी डी एफ", "HR": "एच आर", "CEO": "सी ई ओ", "SBI": "एस बी आई", "HDFC": "एच डी एफ सी", "ICICI": "आई सी आई सी आई", "LIC": "एल आई सी", "RBI": "आर बी आई", "TDS": "टी डी एस", "ITR": "आई टी आर",
    "NEFT": "नेफ़्ट", "RTGS": "आर टी जी एस", "IMPS": "आई एम पी एस", "CIBIL": "सिबिल", "OTT": "ओ टी टी", "GPS": "जी पी एस", "USB": "यू एस बी", "FD": "एफ डी", "SIP": "एस आई पी", "Wi-Fi": "वाई फ़ाई", "WiFi": "वाई फ़ाई",
    "A/C": "अकाउंट", "a/c": "अकाउंट", "A/c": "अकाउंट", "रु.": "रुपये", "रु": "रुपये", "CRM": "सी आर एम", "ID": "आई डी", "QR": "क्यू आर", "EPF": "ई पी एफ", "PPF": "पी पी एफ", "NRI": "एन आर आई", "DOB": "डी ओ बी",
    "NOC": "एन ओ सी", "TV": "टी वी", "LPG": "एल पी जी", "CNG": "सी एन जी", "ML": "एम एल", "VoIP": "वी ओ आई पी", "VOIP": "वी ओ आई पी", "SaaS": "सास", "VPN": "वी पी एन", "LLM": "एल एल एम", "TTS": "टी टी एस",
    "STT": "एस टी टी", "IoT": "आई ओ टी", "SDK": "एस डी के", "FASTag": "फ़ास्टैग", "Sr.": "सीनियर", "Jr.": "जूनियर", "Smt.": "श्रीमती", "Prof.": "प्रोफ़ेसर",
}

#: The private alphabet: printable ASCII from here on, kinds of atoms below it, and marks of pieces.
ALPHABET = 0xE100
_PLAIN = "".join(map(chr, range(0x20, 0x7F)))
_SECRET = "".join(chr(ALPHABET + k) for k in range(0x20, 0x7F))
END, CUT, STEP = "\ue0ff", "\u0001", "\u0002"
KINDS = {name: chr(0xE001 + k) for k, name in enumerate("number amount digits year count rupees scaled ordinal clock month version letters glued groups web fraction".split())}
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
NATIVE_MONTH = r"(?:जनवरी|फ़?रवरी|मार्च|अप्रै?ल|मई|जून|जुलाई|अगस्त|सितंबर|अक्टूबर|नवंबर|दिसंबर)"
NUM = r"[0-9][0-9,]*(?:\.[0-9]+)?"
SCALE = r"(?:lakh|lac|crore|cr|लाख|करोड़|हज़ार|हजार)"
#: No word character (letter, digit, mark, underscore) before, or after.
OPEN, SHUT = r"(?<![\p{L}\p{N}\p{M}_])", r"(?![\p{L}\p{N}\p{M}_])"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit("\n".join(map("\t".join, table.items()))), F.lit("\n"), F.lit("\t")), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nth(words: str, n: Column, by: str = " ") -> Column:
    return F.split_part(F.lit(words), F.lit(by), n.cast("int") + 1)


def digits(s: Column) -> Column:
    """Each digit of a string as a word."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("([0-9])")), lambda c: _nth(UNDER_100, c)), " ")


def count(n: Column) -> Column:
    """Words of a whole number below 10^14, by crore, lakh, thousand and hundred."""

    def small(m: Column) -> Column:
        parts, rest = [], m
        for size, name in ((100_000, LAKH), (1_000, THOUSAND), (100, HUNDRED)):
            k = F.floor(rest / size)
            parts.append(F.when(k > 0, F.concat(_nth(UNDER_100, k), F.lit(f" {name}"))))
            rest = rest % size
        return F.concat_ws(" ", *parts, F.when((rest > 0) | (m == 0), _nth(UNDER_100, rest)))

    def whole(m: Column) -> Column:
        high, low = F.floor(m / 10_000_000), m % 10_000_000
        return F.when(high == 0, small(low)).otherwise(F.concat_ws(" ", small(high), F.lit(CRORE), F.when(low > 0, small(low))))

    return _let(n, whole)


def spoken(s: Column) -> Column:
    """Words of a number as it is written: commas dropped, decimals after a word for the point digit by digit, as are whole numbers of more
    than nine digits or with a leading zero. Beyond 14 digits all are digits."""

    def of(t: Column) -> Column:
        head, tail = F.split_part(t, F.lit("."), F.lit(1)), F.substring_index(t, ".", -1)
        n = _let(F.length(head), lambda k: F.when(k > 14, digits(head)).otherwise(count(F.coalesce(head.try_cast("long"), F.lit(0)))))
        plain = F.when((F.length(t) > 9) | ((F.length(t) > 1) & t.startswith("0")), digits(t)).otherwise(n)
        return F.when(t.contains("."), F.concat(n, F.lit(" दशमलव "), digits(tail))).otherwise(plain)

    return _let(F.replace(s, F.lit(","), F.lit("")), of)


def amount(s: Column) -> Column:
    """As ``spoken``, with halves as they are said: half, one and a half, two and a half, and so on."""

    def of(t: Column) -> Column:
        head = F.split_part(t, F.lit("."), F.lit(1))
        half = F.when(head == "0", "आधा").when(head == "1", "डेढ़").when(head == "2", "ढाई").otherwise(F.concat(F.lit("साढ़े "), count(head.try_cast("long"))))
        return F.when(t.rlike(r"^[0-9]{1,14}\.5$"), half).otherwise(spoken(t))

    return _let(F.replace(s, F.lit(","), F.lit("")), of)


def year(s: Column) -> Column:
    """1100 to 1999 in hundreds, other years as numbers."""
    n, h = s.try_cast("long"), F.floor(s.try_cast("long") / 100)
    hundreds = F.concat_ws(" ", count(h), F.lit(HUNDRED), F.when(n % 100 > 0, count(n % 100)))
    return F.when(n.between(1100, 1999), hundreds).otherwise(count(n))


def rupees(s: Column) -> Column:
    """Whole rupees and the first two decimals as paise."""

    def of(t: Column) -> Column:
        n = F.split_part(t, F.lit("."), F.lit(1)).try_cast("long")
        p = F.rpad(F.substring(F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise(""), 1, 2), 2, "0").try_cast("long")
        paise = F.when(p > 0, F.concat(count(p), F.lit(" पैसे")))
        whole = F.when(n.isNull(), F.concat(digits(F.split_part(t, F.lit("."), F.lit(1))), F.lit(" रुपये"))).when((n == 1) & (p == 0), "एक रुपया").otherwise(F.concat(count(n), F.lit(" रुपये")))
        return F.when((n == 0) & (p > 0), paise).otherwise(F.concat_ws(" ", whole, paise))

    return _let(F.replace(s, F.lit(","), F.lit("")), of)


def scaled(s: Column) -> Column:
    """``amount|scale``: decimals of lakhs and crores, but for halves, are worked out to whole numbers."""
    n, word = F.replace(F.split_part(s, F.lit("|"), F.lit(1)), F.lit(","), F.lit("")), F.split_part(s, F.lit("|"), F.lit(2))
    word = F.coalesce(_lookup(SCALES, word), word)
    unit = F.when(word == LAKH, 100_000).when(word == CRORE, 10_000_000)
    tail = F.substring_index(n, ".", -1)
    exact = n.rlike(r"^[0-9]{1,6}\.[0-9]{1,4}$") & (tail != "5") & unit.isNotNull()
    worth = F.split_part(n, F.lit("."), F.lit(1)).try_cast("long") * unit + F.floor(tail.try_cast("long") * unit / F.pow(F.lit(10), F.length(tail))).cast("long")
    return F.when(exact, count(worth)).otherwise(F.concat_ws(" ", amount(n), word))


def clock(s: Column) -> Column:
    """``hour:minute:marker``: quarters and halves by their names; a marker (a, p) puts the part of the day before."""
    h, m, marker = (F.split_part(s, F.lit(":"), F.lit(k)) for k in (1, 2, 3))
    h, m = h.try_cast("long"), m.try_cast("long")
    hour = count(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("long"))
    half = F.when(h % 12 == 1, "डेढ़").when(h % 12 == 2, "ढाई").otherwise(F.concat(F.lit("साढ़े "), hour))
    at = F.when(m == 0, hour).when(m == 15, F.concat(F.lit("सवा "), hour)).when(m == 30, half).when(m == 45, F.concat(F.lit("पौने "), count(h % 12 + 1)))
    said = F.coalesce(F.concat(at, F.lit(" बजे")), F.concat(hour, F.lit(" बजकर "), count(m), F.lit(" मिनट")))
    late = F.when(h % 12 < 4, "दोपहर").when(h % 12 < 7, "शाम").otherwise("रात")
    return F.concat_ws(" ", F.when(marker == "a", F.when(h % 12 < 4, "रात").otherwise("सुबह")).when(marker == "p", late), said)


def _spelled(s: Column) -> Column:
    """Letters by name, digits as words."""
    letter = lambda c: F.when(c.rlike("[0-9]"), _nth(UNDER_100, c)).otherwise(_nth(LETTERS, F.ascii(c) - 65, ","))
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("([A-Z0-9])")), letter), " ")


def _glued(s: Column) -> Column:
    """Letters by name; two digits as a number; one, or more, by their English names."""
    english = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit("([0-9])")), lambda c: _nth(ENGLISH_DIGITS, c)), " ")
    run = lambda r: F.when(r.rlike("[A-Z]"), _spelled(r)).when(r.rlike("^[1-9][0-9]$"), count(r.try_cast("long"))).otherwise(english(r))
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("([A-Z]+|[0-9]+)")), run), " ")


def _groups(s: Column) -> Column:
    """A number to call: its groups as written, else five and five of ten digits, else by fours; commas between."""
    parts = F.regexp_extract_all(s, F.lit("([0-9]+)"))
    d = F.get(parts, F.lit(0))
    fours = F.regexp_extract_all(d, F.lit("([0-9]{1,4})"))
    groups = F.when(F.size(parts) > 1, parts).when(F.length(d) == 10, F.array(F.substring(d, 1, 5), F.substring(d, 6, 5))).when(F.length(d) > 10, fours).otherwise(F.array(d))
    return F.array_join(F.transform(groups, digits), ", ")


def _web(s: Column) -> Column:
    """An address: marks by name, digits one by one, the last labels of the host as domains; other words stay."""
    bare = F.regexp_replace(s, "^https?://", "")
    host = F.regexp_extract(bare, "^([^/?#]*)", 1)
    labels = F.split(F.substring_index(host, "@", -1), r"\.")
    last = F.element_at(labels, -1)
    before = F.when(F.size(labels) > 2, F.get(labels, F.size(labels) - 2))
    ends = F.when(F.lower(before).isin("co", "gov", "nic", "ac", "org", "net"), F.array(before, last)).otherwise(F.array(last))
    tokens = lambda x: F.regexp_extract_all(x, F.lit("([A-Za-z]+|[0-9]|[^A-Za-z0-9])"))

    def word(in_host: bool):
        def of(t: Column, k: Column) -> Column:
            end = _lookup(DOMAINS, F.lower(t))
            name = F.when(F.lower(t) == "www", "डब्ल्यू डब्ल्यू डब्ल्यू")
            if in_host:
                name = name.when((k > 0) & F.array_contains(ends, t) & end.isNotNull(), end)
            return F.when(t.rlike("[0-9]"), _nth(UNDER_100, t)).when(t.rlike("[A-Za-z]"), name.otherwise(t)).otherwise(F.coalesce(_lookup(WEB_MARKS, t), F.lit("")))

        return of

    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    both = F.concat(F.transform(tokens(host), word(True)), F.transform(tokens(rest), word(False)))
    return F.array_join(F.filter(both, lambda w: w != ""), " ")


def _version(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, r"\."), spoken), " डॉट ")


def _fraction(s: Column) -> Column:
    n = lambda k: count(F.split_part(s, F.lit("/"), F.lit(k)).try_cast("long"))
    return F.coalesce(_lookup(FRACTIONS, F.concat_ws("/", *[F.split_part(s, F.lit("/"), F.lit(k)).try_cast("int").cast("string") for k in (1, 2)])), F.concat_ws(" ", n(1), F.lit("बटा"), n(2)))


def _ordinal(s: Column) -> Column:
    return F.coalesce(_lookup(ORDINALS, s.try_cast("int").cast("string")), F.concat(spoken(F.coalesce(s.try_cast("long").cast("string"), s)), F.lit("वाँ")))


SAY = {
    "number": spoken, "amount": amount, "digits": digits, "year": year, "count": lambda s: count(s.try_cast("long")), "rupees": rupees, "scaled": scaled, "ordinal": _ordinal, "clock": clock,
    "month": lambda s: _nth(MONTHS, s.try_cast("int") - 1), "version": _version, "letters": _spelled, "glued": _glued, "groups": _groups, "web": _web, "fraction": _fraction,
}


@dataclass(frozen=True)
class Rule:
    """``core`` between ``before`` and ``after`` (look-arounds) becomes ``render`` of what it matched; null leaves it as it is."""

    name: str
    core: str
    render: Callable[[Column], Column]
    before: str = ""
    after: str = ""
    flags: str = ""

    def pattern(self) -> str:
        return f"{self.flags}{self.before}(?:{self.core}){self.after}"


def atom(kind: str, text: Column) -> Column:
    return F.concat(F.lit(KINDS[kind]), F.translate(text, _PLAIN, _SECRET), F.lit(END))


def _part(core: str, k: int, flags: str = "") -> Callable[[Column], Column]:
    return lambda x: F.regexp_extract(x, f"{flags}^{core}$", k)


def _same(kind: str) -> Callable[[Column], Column]:
    return lambda x: atom(kind, x)


def _word(text: str) -> Callable[[Column], Column]:
    return lambda x: F.lit(text)


def _rules() -> list[Rule]:
    i = "(?i)"
    out: list[Rule] = []

    def add(name, core, render, before="", after="", flags=""):
        out.append(Rule(name, core, render, before, after, flags))

    def number(name, kind, core, words="{}", before="", after="", group=1):
        part = _part(core, group, i)
        head, tail = words.split("{}")
        add(name, core, lambda x: F.concat(F.lit(head), atom(kind, part(x)), F.lit(tail)), before, after, i)

    def money(name, core, before="", after=""):
        n, s = _part(core, 1, i), _part(core, 2, i)
        scale = lambda x: F.concat(atom("scaled", F.concat_ws("|", n(x), F.lower(s(x)))), F.lit(" रुपये"))
        add(name, core, lambda x: F.when(s(x) != "", scale(x)).otherwise(atom("rupees", n(x))), before, after, i)

    def date(core, d, m, y, named=False):
        day, month, yr = _part(core, d, i), _part(core, m, i), _part(core, y, i)

        def render(x: Column) -> Column:
            if named:
                short = F.substring(F.lower(month(x)), 1, 3)
                no = (F.floor((F.locate("x", F.lit("x")) + F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), short) - 2) / 3) + 1).cast("int")
                return F.concat(atom("count", day(x)), F.lit(" "), atom("month", no.cast("string")), F.when(yr(x) != "", F.concat(F.lit(" "), atom("year", yr(x)))).otherwise(""))
            full = F.when(F.length(yr(x)) == 2, F.concat(F.lit("20"), yr(x))).otherwise(yr(x))
            ok = day(x).try_cast("int").between(1, 31) & month(x).try_cast("int").between(1, 12)
            return F.when(ok, F.concat(atom("count", day(x)), F.lit(" "), atom("month", month(x)), F.lit(" "), atom("year", full)))

        return render

    mail = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    top = r"(?:com|org|net|io|app|info|edu|(?:co|gov|nic|ac|org|net)\.in)"
    add("email", mail, _same("web"), r"(?<![A-Za-z0-9_.+-])")
    url = rf"(?:(?:https?://)(?:www\.)?|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:/[^\s-]*)?|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.{top}(?![\p{{L}}\p{{N}}\p{{M}}_-])(?:/[^\s-]*)?"
    add("url", url, _same("web"), r"(?<![A-Za-z0-9_@.-])", r"(?<![.,;:!?)\]}\"'])")
    codes = r"(?:OTP|PIN|CVV|CVC|code|passcode|कोड|ओटीपी|पिन|पासकोड)"
    link = r"(?:\s{0,2}(?:is|hai|है|:|-|=|#)\s{0,2}|\s{1,3})"
    add("code", "[0-9]{3,8}", _same("digits"), rf"(?=[0-9])(?<={OPEN}{codes}(?:{link}|{link}{link}))", "(?![0-9])", i)
    add("code", "[0-9]{4,8}", _same("digits"), r"(?<![\p{L}\p{N}\p{M}_.])", rf"(?=\s+(?:आपका|आपकी|आपके|your)\s+(?:OTP|ओटीपी|PIN|पिन|code|कोड){SHUT})", i)
    dated = r"^(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.(?:[0-9]{2}|[0-9]{4})$"
    add("version", r"[0-9]+(?:\.[0-9]+){2,}", lambda x: F.when(~x.rlike(dated), atom("version", x)), r"(?<![\p{L}\p{N}\p{M}_.])", r"(?![\p{L}\p{N}\p{M}_.])")
    add("id", "(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{6,}", _same("letters"), OPEN, SHUT)
    add("only", r"\s*/-", _word(""), "(?<=[0-9])")
    add("generation", "[2-6]G", lambda x: F.concat(atom("glued", F.substring(x, 1, 1)), F.lit(" जी")), r"(?<![\p{L}\p{N}\p{M}_.])", "(?![A-Za-z0-9])")
    add("dash", "-", _word(" "), "(?<=[A-Za-z])", "(?=[0-9])")
    core = rf"([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})(?:,?\s+([0-9]{{4}}))?"
    add("date_named", core, date(core, 1, 2, 3, True), OPEN, SHUT, i)
    core = rf"({MONTH_NAMES})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?\s+([0-9]{{4}}))?"
    add("date_named", core, date(core, 2, 1, 3, True), OPEN, r"(?![\p{L}\p{N}\p{M}_:.])", i)
    add("year", r"1[1-9][0-9]{2}", _same("year"), r"(?=1[1-9])(?<=(?:सन्|सन|साल|year|since|till|until|in|from)\s{1,3})", "(?![0-9])", i)
    add("year", r"1[1-9][0-9]{2}", _same("year"), rf"(?=1[1-9])(?<={NATIVE_MONTH}\s{{1,3}})", "(?![0-9])")
    core = rf"₹\s*({NUM})\s*[-–]\s*₹?\s*({NUM})(?:\s*({SCALE})(?![a-z]))?"
    a, b, c = (_part(core, k, i) for k in (1, 2, 3))
    add("currency_range", core, lambda x: F.concat(atom("amount", a(x)), F.lit(" से "), F.when(c(x) != "", F.concat(atom("scaled", F.concat_ws("|", b(x), F.lower(c(x)))), F.lit(" रुपये"))).otherwise(atom("rupees", b(x)))), flags=i)
    money("currency", rf"₹\s*({NUM})(?:\s*(k|{SCALE})(?![a-z]))?")
    money("currency", rf"(?:Rs\.?|INR)\s*({NUM})(?:\s*({SCALE})(?![a-z]))?", OPEN)
    number("currency", "rupees", rf"({NUM})\s*INR", after=SHUT)
    number("currency", "number", rf"\$\s*({NUM})", "{} डॉलर")
    number("currency", "number", rf"({NUM})\s*USD", "{} डॉलर", after=SHUT)
    core = rf"({NUM})\s*(k|{SCALE})"
    n, s = _part(core, 1, i), _part(core, 2, i)
    add("scaled", core, lambda x: atom("scaled", F.concat_ws("|", n(x), F.lower(s(x)))), after="(?![a-z])", flags=i)
    number("currency", "rupees", rf"({NUM})\s*(?:रुपये|रुपए|रुपया|रु\.?(?![ऀ-ॿ\p{{L}}\p{{N}}_]))")
    core = rf"({NUM})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})"
    un, uw = _part(core, 1, i), _part(core, 2, i)
    add("unit", core, lambda x: F.concat(atom("amount", un(x)), F.lit(" "), _lookup(UNITS, F.lower(uw(x)))), OPEN, SHUT, i)
    add("glued", r"(?![0-9]+(?:ST|ND|RD|TH|[AP]M)(?![A-Za-z0-9_]))(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{2,5}", _same("glued"), OPEN, SHUT)
    add("symbol", r"[Nn]o\.\s*", _word("नंबर "), OPEN, "(?=[0-9])")
    add("symbol", "#", _word("नंबर "), "", "(?=[0-9])")
    add("symbol", "#", _word("हैश"), r"(?<!\S)", r"(?!\S)")
    add("symbol", r"\*", _word("स्टार"), r"(?<!\S)", r"(?!\S)")
    names = "|".join(re.escape(k) for k in sorted(SAID, key=len, reverse=True))
    add("abbreviation", names, lambda x: _lookup(SAID, x), OPEN, SHUT)
    core = "([0-9]{4})-([0-9]{2})-([0-9]{2})"
    add("date_iso", core, date(core, 3, 2, 1), "(?<![0-9-])", "(?![0-9-])")
    core = r"([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    add("date_dmy", core, date(core, 1, 2, 3), OPEN, SHUT)
    core = r"([0-9]{1,2})(?::([0-9]{2})(?:\s*(?:([ap])\.?m\.?(?![A-Za-z])|बजे))?|\.([0-9]{2})\s*(?:([ap])\.?m\.?(?![A-Za-z])|बजे))(?![0-9])(?:\s*बजे)?"
    h, m1, p1, m2, p2 = (_part(core, k, i) for k in range(1, 6))
    at = lambda x, marker: atom("clock", F.concat_ws(":", h(x), F.concat(m1(x), m2(x)), marker))
    said = rf"(?=[0-9])(?<=(?:{DAY_PARTS})\s{{0,3}})"
    add("clock", core, lambda x: at(x, F.lit("")), said + OPEN, "", i)
    add("clock", core, lambda x: at(x, F.lower(F.concat(p1(x), p2(x)))), OPEN, "", i)
    hour_core = r"([0-9]{1,2})\s*([ap])\.?m\.?(?![A-Za-z0-9])(?:\s*बजे)?"
    hh, hp = _part(hour_core, 1, i), _part(hour_core, 2, i)
    on_hour = lambda x, marker: F.when(hh(x).try_cast("int").between(1, 12), atom("clock", F.concat_ws(":", hh(x), F.lit("0"), marker)))
    add("clock", hour_core, lambda x: on_hour(x, F.lit("")), said + r"(?<![\p{L}\p{N}\p{M}_:.])", "", i)
    add("clock", hour_core, lambda x: on_hour(x, F.lower(hp(x))), r"(?<![\p{L}\p{N}\p{M}_:.])", "", i)
    core = r"\+([0-9]+)(?:[\s\-]+([0-9][0-9\s\-]*[0-9]))?"
    cc, rest = _part(core, 1), _part(core, 2)
    add("phone", core, lambda x: F.concat(F.lit("प्लस "), atom("digits", cc(x)), F.when(rest(x) != "", F.concat(F.lit(", "), atom("groups", rest(x)))).otherwise("")))
    add("phone", r"[0-9][0-9\s\-]*[0-9]", lambda x: F.when(F.length(F.regexp_replace(x, "[^0-9]", "")) >= 10, atom("groups", x)))
    core = rf"({NUM})\s*[-–]\s*({NUM})"
    r1, r2 = _part(core, 1), _part(core, 2)
    add("range", core, lambda x: F.concat(atom("number", r1(x)), F.lit(" से "), atom("number", r2(x))))
    number("percent", "amount", rf"({NUM})\s*%", "{} प्रतिशत")
    number("percent", "amount", rf"({NUM})\s*(?:percent|per\s?cent)", "{} प्रतिशत", after="(?![a-z])")
    add("degree", r"°\s*[CF]", lambda x: F.when(x.endswith("C"), " डिग्री सेल्सियस").otherwise(" डिग्री फ़ारेनहाइट"), "", "(?![A-Za-z])")
    add("minus", "-", _word("माइनस "), r"(?<![\p{L}\p{N}\p{M}_)])", "(?=[0-9])")
    add("fraction", "[0-9]{1,2}/[0-9]{1,2}", lambda x: F.when(~x.rlike("/0+$"), atom("fraction", x)), "(?<![0-9/.])", "(?![0-9/])")
    number("ordinal", "ordinal", "([0-9]+)(?:st|nd|rd|th)", before=OPEN, after=SHUT)
    add("symbol", "&", _word(" और "))
    add("symbol", "@", _word(" एट "))
    inside = r"[\p{L}\p{N}\p{M}_-]"
    add("symbol", r"\s*\+\s*", _word(" प्लस "), f"(?<={inside})", f"(?={inside})")
    add("symbol", "=", _word(" बराबर "))
    add("symbol", r"\s*/\s*", _word(" या "), r"(?<=[^\s/])", r"(?=[^\s/])")
    add("split", "", _word(" "), "(?<=[A-Za-z])", "(?=[0-9])")
    add("number", NUM, _same("number"))
    return out


RULES = _rules()
NAMES = list(dict.fromkeys(r.name for r in RULES))
#: Tokens that a rule could match, or that one is read with: up to three tokens beside them come along.
_TRIGGER = "0-9@&+=/#*°%₹$"
_PLAIN_NAMES = "|".join(re.escape(k) for k in sorted(SAID, key=len, reverse=True) if not re.search(f"[A-Z]{{2}}|[{_TRIGGER}]", k))
_HOSTS = rf"\.(?:com|org|net|io|app|info|edu|in){SHUT}"
_FIRST = "".join(sorted({k[0] for k in SAID}))
_CORE = rf"(?:[^\s{_TRIGGER}]*+[{_TRIGGER}]|[^\s{_TRIGGER}]*?(?:[A-Z]{{2}}|{_HOSTS}|(?=[{_FIRST}]){OPEN}(?:{_PLAIN_NAMES}){SHUT}))\S*+"


def _region(core: str) -> str:
    return rf"(?<!\S)(?:\S++\s+){{0,3}}?{core}(?:\s+(?:\S++\s+){{0,3}}?{core})*+(?:\s+\S++){{0,3}}"


#: What ``regions`` marks, as one pattern; it tries each token four times by all names, which takes microseconds a character.
REGION = _region(_CORE)
#: What makes a token one that a rule could match, after a look at one character that passes over most of a prose text; and the mark set before it.
MARK = "\u0003"
_SIGN = rf"(?=[^{''.join(c for c in 'abcdefghijklmnopqrstuvwxyz' if c not in _FIRST)} ,])(?:[{_TRIGGER.replace('₹', '')}]|₹|[A-Z]{{2}}|{_HOSTS}|(?=[{_FIRST}]){OPEN}(?:{_PLAIN_NAMES}){SHUT})"
_MARKED_REGION = _region(rf"[^\s{MARK}]*+{MARK}\S*+")


def regions(text: Column) -> Column:
    """``text`` (without ``CUT`` and ``MARK``) with a ``CUT`` on both sides of each region: signs are marked first, in one scan; regions are then found by
    the marks, in texts that have one."""
    cut = lambda m: F.replace(F.regexp_replace(m, _MARKED_REGION, f"{CUT}$0{CUT}"), F.lit(MARK), F.lit(""))
    return _let(F.regexp_replace(text, _SIGN, f"{MARK}$0"), lambda m: F.when(m.contains(MARK), cut(m)).otherwise(m))


def _step(rule: Rule, state: Column) -> Column:
    """The text after a rule, and its number of hits."""

    def of(parts: Column) -> Column:
        made = F.transform(parts, lambda x, k: F.when(k % 2 == 1, rule.render(x)))
        hit = lambda m: F.struct(F.array_join(F.zip_with(m, parts, lambda a, b: F.coalesce(a, b)), "").alias("t"), F.size(F.filter(m, lambda a: a.isNotNull())).alias("n"))
        return _let(made, hit)

    marked = F.regexp_replace(state, rule.pattern(), f"{CUT}$0{CUT}")
    return F.when(state.rlike(rule.pattern()), _let(F.split(marked, CUT, -1), of)).otherwise(F.struct(state.alias("t"), F.lit(0).alias("n")))


def _say(text: Column) -> Column:
    """``text`` with its atoms said."""
    pieces = F.split(F.regexp_replace(text, f"([{KINDS['number']}-{list(KINDS.values())[-1]}][^{END}]*{END})", f"{CUT}$1{CUT}"), CUT, -1)

    def say(x: Column) -> Column:
        body = F.translate(F.substring(x, 2, 1 << 30), _SECRET + END, _PLAIN)
        kind, out = F.substring(x, 1, 1), F
        for name, of in SAY.items():
            out = out.when(kind == KINDS[name], _let(body, of))
        return out.otherwise(x)

    return F.array_join(F.transform(pieces, lambda x, k: F.when(k % 2 == 1, say(x)).otherwise(x)), "")


def _counted(hits: Column, place: int) -> Callable[[Column], Column]:
    """From a step, its text and all hits with those of the step added."""
    return lambda s: F.struct(s["t"].alias("t"), F.transform(hits, lambda v, i: v + F.when(i == place, s["n"]).otherwise(0)).alias("n"))


def rewritten(text: Column) -> Column:
    """Struct of the rewritten text (``t``) and the hits of each rule (``n``, in the order of ``NAMES``)."""
    start = F.struct(text.alias("t"), F.array(*[F.lit(0)] * len(NAMES)).alias("n"))

    def run(acc: Column, k: Column) -> Column:
        out = F
        for at, rule in enumerate(RULES):
            out = out.when(k == at, _let(_step(rule, acc["t"]), _counted(acc["n"], NAMES.index(rule.name))))
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), start, run, lambda acc: F.struct(_say(acc["t"]).alias("t"), acc["n"].alias("n")))


def verbalize(rows: DataFrame, text: str, out: str = "spoken", hits: str = "hits") -> DataFrame:
    """``rows`` with the text in words, and a map from rule to hits (rules without hits are left out).

    Digits of the Devanagari block count as ASCII; characters that the rewriting uses for itself are dropped. Null texts stay null, with null hits;
    blank texts become empty, with none. White space is collapsed, and goes before marks.
    """
    clean = F.regexp_replace(F.translate(text, "०१२३४५६७८९", "0123456789"), "[\ue000-\ue1ff\u0001-\u0003]", "")
    pieces = F.split(regions(clean), CUT, -1)

    def of(p: Column) -> Column:
        regions = F.array_join(F.transform(p, lambda x, k: F.when(k % 2 == 1, x)), STEP)  # nulls are left out
        back = lambda r: _let(F.split(r["t"], STEP, -1), lambda b: F.array_join(F.transform(p, lambda x, k: F.when(k % 2 == 1, F.get(b, F.shiftright(k, 1))).otherwise(x)), ""))
        made = _let(rewritten(regions), lambda r: F.struct(back(r).alias("t"), r["n"].alias("n")))
        return F.when(F.size(p) > 1, made).otherwise(F.struct(F.get(p, F.lit(0)).alias("t"), F.array(*[F.lit(0)] * len(NAMES)).alias("n")))

    name = unused("_made", rows.columns)
    made = rows.withColumn(name, F.when(F.col(text).isNotNull(), _let(pieces, of)))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.col(name)["t"], r"\s+([,.?!।])", "$1"), r"\s+", " "))
    some = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.col(name)["n"]), lambda _, v: v > 0)
    return made.withColumn(name, F.struct(tidy.alias("t"), some.alias("n"))).withColumns({out: F.col(name)["t"], hits: F.when(F.col(name)["t"].isNotNull(), F.col(name)["n"])}).drop(name)
