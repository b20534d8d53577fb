"""Word lists and tables of the engine: configuration data, swappable as a whole."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

# ---- Fixed values: they must equal the published ones for equal results. ----
ARABIC_FROM = "٠١٢٣٤٥٦٧٨٩آأإٱىئؤة"
ARABIC_TO = "0123456789ااااييوه"
DIACRITICS = "[ً-ٰٟـ]"
ENGLISH_NOISE = (
    "AND PRICE DOSE DOS USE USES GENERIC FORTE TABLET TABLETS TAB TABS CAP CAPS CAPSULE SYRUP DROP DROPS MG MCG IU G GM ML VIAL AMP AMPOULE INJECTION PEN PENS"
)
ARABIC_NOISE = "سعر بكام جرام جم مل اقراص قرص كبسول كبسوله كبسولة كبسولات شراب حقن حقنه حقنة فيال امبول امبوله امبولة"
GENERIC = (
    "PLUS EXTRA FORTE ADVANCE MAX SUPER ULTRA NEW ACTIVE NATURAL GOLD SILVER BIO VITA VIT PRO CARE SKIN HAIR BABY KIDS ADULT DRUG MEDICINE CREAM GEL LOTION SOAP SHAMPOO MASK"
)
QUALIFIERS = "EXTRA PLUS FORTE MAX MONO DUO ADVANCE ACTIVE GOLD SILVER N S SR XR MR"
ROUTES = {
    "oral_solid": "TAB TABS TABLET TABLETS CAP CAPS CAPSULE قرص اقراص كبسول كبسوله كبسولة",
    "oral_liquid": "SYRUP SUSP SUSPENSION DROPS شراب معلق نقط قطره قطرة",
    "injection": "VIAL AMP AMPOULE INJ INF IV IM حقن حقنة فيال امبول أمبول امبولة",
    "topical": "CREAM GEL OINT LOTION مرهم كريم جل",
    "soap": "SOAP",
    "spray": "SPRAY بخاخ",
    "ophthalmic": "EYE",
    "otic": "EAR",
    "mouth": "MOUTH",
    "rectal": "RECTAL SUPP لبوس",
    "vaginal": "VAG VAGINAL",
}
ALIASES = {
    "PANADOL": "BANADOL BANADOLCOLD BANADOLE BANDOL PANDOL PANDOLCOLD BANDOLCOLD PANADL PANADOLE بنادول باندول",
    "AUGMENTIN": "OGMENTIN OGMNTIN AUGMNTIN AUGMANTIN اوجمنتين اوجمانتين اوجمنتن",
    "NEXIUM": "NEKSIUM NEKSUM NEXUM NEXEUM نكسيوم",
    "LIPITOR": "LIPTOR LEPITOR LIPTUR ليبتور",
    "BRUFEN": "BRUFN BRUFIN BROFEN بروفين",
    "KETOFAN": "KETOFN KETOFEN KETOFANE كيتوفان",
    "VOLTAREN": "VOLTARIN FOLTAREN فولتارين",
}
CONTEXT_NOISE = (
    "MG MCG G GM GRAM GRAMS ML L IU UNIT UNITS PERCENT PER TAB TABS TABLET TABLETS CAP CAPS CAPSULE CAPSULES SYRUP SUSP SUSPENSION VIAL VIALS AMP AMPS AMPOULE AMPOULES "
    "CREAM GEL OINT OINTMENT DROPS DROP ORAL TOPICAL INJ INJECTION FC FCT SC SR XR MR RETARD SACHET SACHETS"
)
UNIT_SUFFIX = "^[0-9]+(MG|MCG|G|GM|ML|L|IU|%)$"
VOWELS = "AEIOUY"
CONFUSION = "CKQ SZ FV PB DT GJ MN IEY OU"
KEY_ROWS = "QWERTYUIOP ASDFGHJKL ZXCVBNM"
KEY_EXTRA = {
    "Q": "A", "W": "AS", "E": "SD", "R": "DF", "T": "FG", "Y": "GH", "U": "HJ", "I": "JK", "O": "KL", "P": "L", "A": "QWZ", "S": "QWEXZ",
    "D": "WERFCX", "F": "ERTGVC", "G": "RTYHBV", "H": "TYUJNB", "J": "YUIKMN", "K": "UIOLM", "L": "OPK", "Z": "ASX", "X": "ASDCZ", "C": "SDFVX",
    "V": "DFGBC", "B": "FGHNV", "N": "GHJMB", "M": "HJKN",
}
LOOKALIKES = (
    ("RN", "M"), ("M", "RN"), ("CL", "D"), ("D", "CL"), ("RI", "N"), ("N", "RI"), ("LI", "H"), ("H", "LI"), ("VV", "W"), ("W", "VV"), ("0", "O"),
    ("O", "0"), ("1", "I"), ("I", "1"), ("1", "L"), ("L", "1"), ("5", "S"), ("S", "5"), ("8", "B"), ("B", "8"), ("2", "Z"), ("Z", "2"), ("6", "G"),
    ("G", "6"),
)
WARNING_LABELS = {
    "NON_MEDICINE_OR_METADATA": "Not a medicine record", "UNKNOWN_ROUTE": "Unknown route", "MISSING_COMPOSITION": "Missing composition", "ROUTE_CONFLICT": "Route conflict",
    "QUALITY_REVIEW": "Review", "ILLEGAL_IMPORT": "Illegal import", "CANCELLED": "Cancelled", "N/A": "N/A",
}
ROUTE_LABELS = {
    "oral_solid": "Tablet / capsule", "oral_liquid": "Oral liquid", "injection": "Injection", "topical": "Topical", "ophthalmic": "Eye", "otic": "Ear",
    "rectal": "Rectal", "vaginal": "Vaginal", "mouth": "Mouth", "spray": "Spray", "soap": "Soap", "unknown": "Unknown route",
}
# ---- End of fixed values. ----


@dataclass(frozen=True)
class Lexicon:
    noise: tuple[str, ...] = tuple(f"{ENGLISH_NOISE} {ARABIC_NOISE}".split())
    generic: tuple[str, ...] = tuple(GENERIC.split())
    qualifiers: tuple[str, ...] = tuple(QUALIFIERS.split())
    context_noise: tuple[str, ...] = tuple(CONTEXT_NOISE.split())

    @property
    def routes(self) -> dict[str, str]:
        return {word: route for route, words in ROUTES.items() for word in words.split()}

    @property
    def aliases(self) -> dict[str, str]:
        return {word: base for base, words in ALIASES.items() for word in words.split()}

    @property
    def confusable(self) -> dict[str, str]:
        """Each letter's confusable ones, as a string."""
        pairs: dict[str, str] = {}
        for group in CONFUSION.split():
            for a, b in permutations(group, 2):
                pairs[a] = pairs.get(a, "") + b
        return pairs

    @property
    def neighbours(self) -> dict[str, str]:
        """Each key, the keys beside it on its row, and its extra ones."""
        found: dict[str, str] = {}
        for row in KEY_ROWS.split():
            for i, key in enumerate(row):
                found[key] = row[max(0, i - 1) : i + 2]
        for key, extra in KEY_EXTRA.items():
            found[key] += extra
        return found

    @property
    def lookalikes(self) -> tuple[tuple[str, str], ...]:
        return LOOKALIKES


LEXICON = Lexicon()
