"""[G29] Stems of Romanian words by the public Snowball rules for that language, as text search reduces words to lexemes.

The rules are stated as they are published: regions, then suffixes by step, the longest that ends the word."""

from __future__ import annotations

from functools import lru_cache

# The suffixes of each step and what they become.
PLURALS = {"": "ul ului", "a": "aua", "e": "ea ele elor", "i": "ii iua iei iile iilor ilor", "ile": "ile", "at": "atei", "aţi": "aţie aţia"}
COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
STANDARD = {
    "": "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă",
    "une": "iune iuni", "ist": "ism isme ist ista iste isti istă işti",
}
VERBS = {
    "guarded": "are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui aşi arăm arăţi ară uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră "
    "asem aseşi ase aserăm aserăţi aseră isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră usem useşi use userăm userăţi useră",
    "free": "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră",
}
ENDS = "a e i ie ă"
VOWELS = set("aeiouăâî")
COMMAS = str.maketrans("șț", "şţ")


def _table(rules: dict[str, str]) -> dict[str, str]:
    return {suffix: to for to, suffixes in rules.items() for suffix in suffixes.split()}


STEP0, STEP1, STEP2, STEP3, STEP4 = _table(PLURALS), _table(COMBINED), _table(STANDARD), _table(VERBS), _table({"": ENDS})


def _longest(word: str, table: dict[str, str], region: int | None = None) -> str | None:
    """The longest suffix of the word in the table; with a region, among those within it."""
    return next((word[i:] for i in range(max(region or 0, len(word) - 9), len(word)) if word[i:] in table), None)


def _after(word: str, at: int) -> int:
    """The place after the first consonant that follows a vowel, from ``at`` on."""
    for i in range(at + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    first, second = word[0] in VOWELS, word[1] in VOWELS
    if not second:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if first:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


@lru_cache(maxsize=100_000)
def romanian(word: str) -> str:
    """The stem of a lower-case word; comma letters count as cedilla letters."""
    word = word.translate(COMMAS)
    w = "".join(c.upper() if c in "ui" and 0 < i < len(word) - 1 and word[i - 1] in VOWELS and word[i + 1] in VOWELS else c for i, c in enumerate(word))
    r1 = _after(w, 0)
    r2, rv = _after(w, r1), _rv(w)

    suffix = _longest(w, STEP0)
    if suffix and len(w) - len(suffix) >= r1:
        base = w[: len(w) - len(suffix)]
        if suffix == "ile":
            w = w if base.endswith("ab") else base + "i"
        else:
            w = base + STEP0[suffix]
    done = False
    while (suffix := _longest(w, STEP1)) and len(w) - len(suffix) >= r1:
        w, done = w[: len(w) - len(suffix)] + STEP1[suffix], True
    suffix = _longest(w, STEP2)
    if suffix and len(w) - len(suffix) >= r2:
        base = w[: len(w) - len(suffix)]
        if STEP2[suffix] != "une":
            w, done = base + STEP2[suffix], True
        elif base.endswith("ţ"):
            w, done = base[:-1] + "t", True
    if not done:
        suffix = _longest(w, STEP3, rv)
        if suffix:
            base = w[: len(w) - len(suffix)]
            if STEP3[suffix] == "free" or len(base) > rv and (base[-1] not in VOWELS or base[-1] == "u"):
                w = base
    suffix = _longest(w, STEP4, rv)
    return (w[: len(w) - len(suffix)] if suffix else w).lower()
