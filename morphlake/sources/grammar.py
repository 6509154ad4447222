"""A small Latin rule book: paradigm tables written as endings, and a lexicon of common words.

The tables state school grammar. They serve tests and examples; larger books come through
sources.rulefiles or Parquet.
"""

from __future__ import annotations

CASES = ("NOM", "VOC", "GEN", "DAT", "ACC", "ABL")
#: (declension, variant, gender): endings of the singular and plural in the order of CASES; a leading 1
#: marks the first stem, all others stand on the second.
NOUNS = {
    (1, 1, "C"): ("1a 1a ae ae am a", "ae ae arum is as is"), (2, 1, "M"): ("1us e i o um o", "i i orum is os is"), (2, 2, "N"): ("1um 1um i o um o", "a a orum is a is"),
    (2, 3, "M"): ("1- 1- i o um o", "i i orum is os is"), (3, 1, "C"): ("1- 1- is i em e", "es es um ibus es ibus"), (3, 2, "N"): ("1- 1- is i 1- e", "a a um ibus a ibus"),
    (4, 1, "C"): ("1us 1us us ui um u", "us us uum ibus us ibus"), (5, 1, "C"): ("1es 1es ei ei em e", "es es erum ebus es ebus"),
}
#: Endings of adjectives by gender, as those of NOUNS; the positive on stems 1 and 2.
ADJECTIVES = {
    (1, 1): {"M": ("1us e i o um o", "i i orum is os is"), "F": ("1a 1a ae ae am a", "ae ae arum is as is"), "N": ("1um 1um i o um o", "a a orum is a is")},
    (3, 2): {"C": ("1is 1is is i em i", "es es ium ibus es ibus"), "N": ("1e 1e is i 1e i", "ia ia ium ibus ia ibus")},
}
COMPARATIVE = {"C": ("or or oris ori orem ore", "ores ores orum oribus ores oribus"), "N": ("us us oris ori us ore", "ora ora orum oribus ora oribus")}
PARTICIPLE = ADJECTIVES[1, 1]
PRESENT_PARTICIPLE = {"C": ("ns ns ntis nti ntem nte", "ntes ntes ntium ntibus ntes ntibus")}
#: Persons 1 to 3 of the singular, then of the plural; a leading 1 marks the first stem.
PRESENT_SYSTEM = {
    (1, 1): {
        ("PRES", "ACTIVE", "IND"): "1o as at amus atis ant", ("PRES", "PASSIVE", "IND"): "1or aris atur amur amini antur", ("IMPF", "ACTIVE", "IND"): "abam abas abat abamus abatis abant",
        ("IMPF", "PASSIVE", "IND"): "abar abaris abatur abamur abamini abantur", ("FUT", "ACTIVE", "IND"): "abo abis abit abimus abitis abunt", ("FUT", "PASSIVE", "IND"): "abor aberis abitur abimur abimini abuntur",
        ("PRES", "ACTIVE", "SUB"): "em es et emus etis ent", ("PRES", "PASSIVE", "SUB"): "er eris etur emur emini entur", ("IMPF", "ACTIVE", "SUB"): "arem ares aret aremus aretis arent",
    },
    (2, 1): {
        ("PRES", "ACTIVE", "IND"): "1eo es et emus etis ent", ("PRES", "PASSIVE", "IND"): "1eor eris etur emur emini entur", ("IMPF", "ACTIVE", "IND"): "ebam ebas ebat ebamus ebatis ebant",
        ("FUT", "ACTIVE", "IND"): "ebo ebis ebit ebimus ebitis ebunt", ("PRES", "ACTIVE", "SUB"): "eam eas eat eamus eatis eant", ("IMPF", "ACTIVE", "SUB"): "erem eres eret eremus eretis erent",
    },
    (3, 1): {
        ("PRES", "ACTIVE", "IND"): "1o is it imus itis unt", ("PRES", "PASSIVE", "IND"): "1or eris itur imur imini untur", ("IMPF", "ACTIVE", "IND"): "ebam ebas ebat ebamus ebatis ebant",
        ("FUT", "ACTIVE", "IND"): "am es et emus etis ent", ("PRES", "ACTIVE", "SUB"): "am as at amus atis ant", ("IMPF", "ACTIVE", "SUB"): "erem eres eret eremus eretis erent",
    },
    (3, 4): {
        ("PRES", "ACTIVE", "IND"): "1io is it imus itis iunt", ("PRES", "PASSIVE", "IND"): "1ior iris itur imur imini iuntur", ("IMPF", "ACTIVE", "IND"): "iebam iebas iebat iebamus iebatis iebant",
        ("FUT", "ACTIVE", "IND"): "iam ies iet iemus ietis ient", ("PRES", "ACTIVE", "SUB"): "iam ias iat iamus iatis iant", ("IMPF", "ACTIVE", "SUB"): "irem ires iret iremus iretis irent",
    },
}
#: Imperative singular and plural, infinitive active and passive, vowel of the present participle.
OTHER_PRESENT = {(1, 1): ("a", "ate", "are", "ari", "a"), (2, 1): ("e", "ete", "ere", "eri", "e"), (3, 1): ("e", "ite", "ere", "i", "e"), (3, 4): ("i", "ite", "ire", "iri", "ie")}
PERFECT_SYSTEM = {
    ("PERF", "ACTIVE", "IND"): "i isti it imus istis erunt", ("PLUP", "ACTIVE", "IND"): "eram eras erat eramus eratis erant", ("FUTP", "ACTIVE", "IND"): "ero eris erit erimus eritis erint",
    ("PERF", "ACTIVE", "SUB"): "erim eris erit erimus eritis erint", ("PLUP", "ACTIVE", "SUB"): "issem isses isset issemus issetis issent",
}
#: Forms of qui on its stems qu- and cu-: key, case, number, gender, ending.
QUI = "1 NOM S M i,1 NOM S F ae,1 NOM S N od,1 NOM S C is,1 NOM S N id,2 GEN S X ius,2 DAT S X i,1 ACC S M em,1 ACC S F am,1 ABL S M o,1 ABL S F a,1 NOM P M i,1 NOM P F ae,1 GEN P M orum,1 DAT P X ibus,1 ABL P X ibus,1 ACC P M os,1 ACC P F as"

#: Lemma: part of speech, paradigm, gender or kind, stems, gloss.
LEXICON = """
puella N 1 1 F puell puell | girl
rosa N 1 1 F ros ros | rose
poeta N 1 1 M poet poet | poet
dominus N 2 1 M domin domin | master
amicus N 2 1 M amic amic | friend
bellum N 2 2 N bell bell | war
templum N 2 2 N templ templ | temple
puer N 2 3 M puer puer | boy
rex N 3 1 M rex reg | king
urbs N 3 1 F urbs urb | city
miles N 3 1 M miles milit | soldier
corpus N 3 2 N corpus corpor | body
manus N 4 1 F man man | hand
res N 5 1 F r r | thing
civis N 3 1 C civis civ | citizen
bonus ADJ 1 1 X bon bon meli optim | good
magnus ADJ 1 1 X magn magn mai maxim | great
altus ADJ 1 1 X alt alt alti altissim | high
fortis ADJ 3 2 X fort fort forti fortissim | brave
amo V 1 1 TRANS am am amav amat | love
porto V 1 1 TRANS port port portav portat | carry
voco V 1 1 TRANS voc voc vocav vocat | call
hortor V 1 1 DEP hort hort - hortat | urge
moneo V 2 1 TRANS mon mon monu monit | warn
impleo V 2 1 TRANS impl impl implev implet | fill
audeo V 2 1 SEMIDEP aud aud - aus | dare
duco V 3 1 TRANS duc duc dux duct | lead
rego V 3 1 TRANS reg reg rex rect | rule
mitto V 3 1 TRANS mitt mitt mis miss | send
pluo V 3 1 IMPERS plu plu plu - | rain
audio V 3 4 TRANS aud aud audiv audit | hear
saepe ADV 0 0 X saepe - - | often
non ADV 0 0 X non - - | not
in PREP 0 0 ABL in | in
ad PREP 0 0 ACC ad | to
et CONJ 0 0 X et | and
heu INTERJ 0 0 X heu | alas
"""

PREFIXES = [("ad", "", "X", False, "to"), ("de", "", "X", False, "down"), ("per", "", "X", False, "through"), ("re", "", "X", False, "back"), ("ec", "", "X", True, "is there any"), ("ne", "", "X", True, "not")]
#: fix, connector, root (part, key, declension, variant), target (part, declension, variant, gender, degree, key), coexists, gloss
SUFFIXES = [
    ("or", "", ("V", 4, 0, 0), ("N", 3, 1, "M", "X", 0), False, "one who"),
    ("e", "", ("ADJ", 2, 1, 1), ("ADV", 0, 0, "X", "POS", 1), True, "-ly"),
    ("ul", "", ("N", 2, 0, 0), ("N", 1, 1, "F", "X", 0), False, "little"),
]
#: fix, base part, enclitic, packon, gloss
TACKONS = [("que", "X", True, False, "and"), ("ne", "X", True, False, "question"), ("ve", "X", True, False, "or"), ("cumque", "PRON", False, True, "-ever"), ("dam", "PRON", False, True, "certain"), ("met", "PRON", False, False, "self"), ("pte", "X", False, False, "own")]
#: kind, priority, stage, operation, scope, reverse, before, after, part, key, least before, least after, constraint, medieval, name
REWRITES = [
    ("SYNCOPE", 0, "MAIN", "LITERAL", "INTERNAL", True, "ii", "ivi", "V", 3, 0, 0, "ANY", False, "perfect in -ii"),
    ("SYNCOPE", 1, "MAIN", "LITERAL", "INTERNAL", True, "as", "avis", "V", 3, 0, 1, "ANY", False, "contracted perfect in -a"),
    ("SYNCOPE", 1, "MAIN", "LITERAL", "INTERNAL", True, "es", "evis", "V", 3, 0, 1, "ANY", False, "contracted perfect in -e"),
    ("ORTHOGRAPHIC", 0, "EARLY", "LITERAL", "INITIAL", False, "inpl", "impl", "X", 0, 0, 0, "ANY", False, "assimilated prefix"),
    ("ORTHOGRAPHIC", 0, "FALLBACK", "LITERAL", "FINAL", False, "e", "ae", "X", 0, 2, 0, "ANY", True, "e for ae"),
    ("ORTHOGRAPHIC", 1, "FALLBACK", "LITERAL", "INTERNAL", False, "th", "t", "X", 0, 0, 0, "ANY", True, "th for t"),
    ("ORTHOGRAPHIC", 2, "FALLBACK", "DOUBLE_CONSONANT", "INTERNAL", False, "", "", "X", 0, 0, 0, "ANY", False, "one for two consonants"),
    ("ORTHOGRAPHIC", 3, "FALLBACK", "SLUR", "INITIAL", False, "ad", "", "X", 0, 0, 0, "ANY", False, "slurred ad"),
]


def _fold(text: str) -> str:
    return text.replace("j", "i").replace("v", "u")


def inflection_rules() -> list[tuple]:
    """Rows of the rules table, ids in order from 0."""
    out: list[tuple] = []

    def add(pos, decl, var, case="X", number="X", gender="X", degree="X", tense="X", voice="X", mood="X", person=0, key=1, ending=""):
        out.append((len(out), pos, decl, var, case, number, gender, degree, tense, voice, mood, person, key, _fold(ending), "X", "A"))

    def table(cells, key=2):
        for number, row in zip("SP", cells, strict=True):
            for case, cell in zip(CASES, row.split(), strict=True):
                first = cell[0] == "1"
                yield case, number, 1 if first else key, cell.lstrip("1").replace("-", "")

    for pos in ("CONJ", "INTERJ"):
        add(pos, 0, 0)
    for degree, key in (("POS", 1), ("COMP", 2), ("SUPER", 3)):
        add("ADV", 0, 0, degree=degree, key=key)
    for case in ("ACC", "ABL", "GEN"):
        add("PREP", 0, 0, case=case)
    for (decl, var, gender), cells in NOUNS.items():
        for case, number, key, ending in table(cells):
            add("N", decl, var, case, number, gender, key=key, ending=ending)
    for (decl, var), genders in ADJECTIVES.items():
        for gender, cells in genders.items():
            for case, number, key, ending in table(cells):
                add("ADJ", decl, var, case, number, gender, "POS", key=key, ending=ending)
    for gender, cells in COMPARATIVE.items():
        for case, number, _, ending in table(cells):
            add("ADJ", 0, 0, case, number, gender, "COMP", key=3, ending=ending)
    for gender, cells in PARTICIPLE.items():
        for case, number, _, ending in table(cells):
            add("ADJ", 0, 0, case, number, gender, "SUPER", key=4, ending=ending)
            add("VPAR", 0, 0, case, number, gender, tense="PERF", voice="PASSIVE", key=4, ending=ending)
            add("VPAR", 0, 0, case, number, gender, tense="FUT", voice="ACTIVE", key=4, ending="ur" + ending)
    add("SUPINE", 0, 0, "ACC", "S", "N", key=4, ending="um")
    add("SUPINE", 0, 0, "ABL", "S", "N", key=4, ending="u")
    persons = [("S", 1), ("S", 2), ("S", 3), ("P", 1), ("P", 2), ("P", 3)]
    for (decl, var), tenses in PRESENT_SYSTEM.items():
        for (tense, voice, mood), cells in tenses.items():
            for (number, person), cell in zip(persons, cells.split(), strict=True):
                add("V", decl, var, number=number, tense=tense, voice=voice, mood=mood, person=person, key=1 if cell[0] == "1" else 2, ending=cell.lstrip("1"))
        singular, plural, active, passive, vowel = OTHER_PRESENT[decl, var]
        add("V", decl, var, number="S", tense="PRES", voice="ACTIVE", mood="IMP", person=2, key=2, ending=singular)
        add("V", decl, var, number="P", tense="PRES", voice="ACTIVE", mood="IMP", person=2, key=2, ending=plural)
        add("V", decl, var, tense="PRES", voice="ACTIVE", mood="INF", key=2, ending=active)
        add("V", decl, var, tense="PRES", voice="PASSIVE", mood="INF", key=2, ending=passive)
        for gender, cells in PRESENT_PARTICIPLE.items():
            for case, number, _, ending in table(cells):
                add("VPAR", decl, var, case, number, gender, tense="PRES", voice="ACTIVE", key=2, ending=vowel + ending)
        for gender, cells in PARTICIPLE.items():
            for case, number, _, ending in table(cells):
                add("VPAR", decl, var, case, number, gender, tense="FUT", voice="PASSIVE", key=2, ending=vowel + "nd" + ending)
    add("V", 3, 1, number="S", tense="PRES", voice="ACTIVE", mood="IMP", person=2, key=2, ending="")
    for (tense, voice, mood), cells in PERFECT_SYSTEM.items():
        for (number, person), ending in zip(persons, cells.split(), strict=True):
            add("V", 0, 0, number=number, tense=tense, voice=voice, mood=mood, person=person, key=3, ending=ending)
    add("V", 0, 0, tense="PERF", voice="ACTIVE", mood="INF", key=3, ending="isse")
    for (number, person), (key, ending) in zip(persons, [(1, "um"), (2, ""), (2, "t"), (1, "umus"), (2, "tis"), (1, "unt")], strict=True):
        add("V", 5, 1, number=number, tense="PRES", voice="ACTIVE", mood="IND", person=person, key=key, ending=ending)
    add("V", 5, 1, tense="PRES", voice="ACTIVE", mood="INF", key=2, ending="se")
    for cell in QUI.split(","):
        key, case, number, gender, ending = cell.split(" ")
        add("PRON", 1, 1, case, number, gender, key=int(key), ending=ending)
    return out


def rows() -> dict[str, list[tuple]]:
    """Rows of every table of a rule book."""
    lexemes, stems = [], []
    rules = inflection_rules()
    names = [r[0] for r in PREFIXES]
    first_suffix, first_tackon = len(names), len(names) + len(SUFFIXES)
    packon = {fix: first_tackon + k for k, (fix, _, _, is_packon, _) in enumerate(TACKONS) if is_packon}

    def entry(pos, decl, var, kind, parts, meaning, required=None):
        n = len(lexemes)
        gender = kind if pos == "N" else "X"
        lexemes.append((n, pos, decl, var, gender, "X", "X", kind if pos == "V" else "X", kind if pos == "PREP" else "X", required, "X", "A", "fixture", meaning))
        for slot, s in enumerate(parts, 1):
            if s != "-":
                stems.append((n, slot, slot, _fold(s)))
        return n

    ids = {}
    for line in LEXICON.strip().splitlines():
        head, meaning = line.split(" | ")
        lemma, pos, decl, var, kind, *parts = head.split()
        ids[lemma] = entry(pos, int(decl), int(var), kind, parts, meaning)
    ids["sum"] = entry("V", 5, 1, "TO_BE", ["s", "es", "fu", "fut"], "be")
    ids["qui"] = entry("PRON", 1, 1, "X", ["qu", "cu"], "who")
    ids["aliqui"] = entry("PRON", 1, 1, "X", ["aliqu", "alicu"], "some")
    ids["quicumque"] = entry("PACK", 1, 1, "X", ["qu", "cu"], "whoever", packon["cumque"])
    ids["quidam"] = entry("PACK", 1, 1, "X", ["qu", "cu"], "a certain", packon["dam"])
    uniques = [
        (form, ids["sum"], "V", 5, 1, None, number, None, None, tense, "ACTIVE", "IND", person)
        for tense, cells in (("IMPF", "eram eras erat eramus eratis erant"), ("FUT", "ero eris erit erimus eritis erunt"))
        for (number, person), form in zip([("S", 1), ("S", 2), ("S", 3), ("P", 1), ("P", 2), ("P", 3)], cells.split(), strict=True)
    ]
    rule_of = {(r[1], r[2], r[3], r[4], r[5], r[13]): r[0] for r in rules}
    quantities = [
        ("INFLECTION", rule_of["N", 1, 1, "NOM", "S", "a"], 0, 1, 0), ("INFLECTION", rule_of["N", 1, 1, "VOC", "S", "a"], 0, 1, 0), ("INFLECTION", rule_of["N", 1, 1, "ABL", "S", "a"], 0, 1, 1),
        ("STEM", ids["rosa"], 1, 2, 0), ("STEM", ids["rosa"], 2, 2, 0),
    ]
    return {
        "lexemes": lexemes, "stems": stems, "rules": rules, "uniques": uniques, "quantities": quantities,
        "prefixes": [(k, *r) for k, r in enumerate(PREFIXES)],
        "suffixes": [(first_suffix + k, fix, c, *root, *target, coexists, m) for k, (fix, c, root, target, coexists, m) in enumerate(SUFFIXES)],
        "tackons": [(first_tackon + k, _fold(fix), pos, 0, 0, enclitic, pack, m) for k, (fix, pos, enclitic, pack, m) in enumerate(TACKONS)],
        "rewrites": [(k, *r) for k, r in enumerate(REWRITES)],
        "notices": [(ids["audeo"], "semideponent_passive_present_system", "related_passive_usage_attested")],
    }
