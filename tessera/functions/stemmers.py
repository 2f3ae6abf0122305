"""Porter, Lancaster and Spanish Snowball stemmers, applied to distinct terms and joined back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Porter (1980) ---


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return i == 0 or not _consonant(w, i - 1) if c == "y" else True


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _replace(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


def porter(w: str) -> str:
    """Stem of a lower-case English word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# --- Lancaster (Paice and Husk, 1990): reversed ending, * for an intact word, letters to cut, letters to add, > to go on ---

_RULES = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y>
ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2.
msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3>
su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y>
ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
""".split()
_BY_LAST: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _rule in _RULES:
    _m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", _rule)
    _BY_LAST.setdefault(_rule[0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(w: str) -> str:
    """Stem of a lower-case English word."""
    start = w
    while w:
        for ending, intact, cut, add, more in _BY_LAST.get(w[-1], ()):
            if not w.endswith(ending) or (intact and w != start):
                continue
            stem = w[: len(w) - cut]
            ok = len(stem) >= 2 if w[0] in "aeiouy" else len(stem) >= 3 and any(c in "aeiouy" for c in stem)
            if ok:
                w = stem + add
                if not more:
                    return w
                break
        else:
            return w
    return w


# --- Snowball, Spanish ---

_V = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")
_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
_BEFORE = ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir")
_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_OTHER = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_GU = "en es éis emos".split()
_VERB = """
arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis
iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas
idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos
""".split()


def _regions(w: str) -> tuple[int, int, int]:
    n = len(w)

    def after(i: int) -> int:
        while i + 1 < n:
            if w[i] in _V and w[i + 1] not in _V:
                return i + 2
            i += 1
        return n

    r1 = after(0)
    r2 = after(r1) if r1 < n else n
    rv = n
    if n >= 2:
        if w[1] not in _V:
            rv = next((i + 1 for i in range(2, n) if w[i] in _V), n)
        elif w[0] in _V:
            rv = next((i + 1 for i in range(2, n) if w[i] not in _V), n)
        else:
            rv = min(3, n)
    return rv, r1, r2


def _longest(w: str, endings: list[str] | tuple[str, ...], at: int) -> str | None:
    """The longest ending that lies wholly at or after ``at``."""
    found = [e for e in endings if w.endswith(e) and len(w) - len(e) >= at]
    return max(found, key=len) if found else None


def spanish(w: str) -> str:
    """Stem of a lower-case Spanish word."""
    rv, r1, r2 = _regions(w)
    # attached pronouns
    pronoun = _longest(w, _PRONOUNS, 0)
    if pronoun and len(w) - len(pronoun) >= rv:
        stem = w[: -len(pronoun)]
        verb = _longest(stem, _BEFORE, rv)
        if verb:
            w = stem[: -len(verb)] + verb.translate(_PLAIN)
        elif stem.endswith("yendo") and len(stem) - 5 >= rv and stem[:-5].endswith("u"):
            w = stem
    start = w
    every = [*_DELETE, *_IC, *_OTHER, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    suffix = _longest(w, every, 0)
    if suffix:
        stem = w[: -len(suffix)]
        in_r2 = len(stem) >= r2

        def drop(x: str, *endings: str) -> str:
            for e in endings:
                if x.endswith(e) and len(x) - len(e) >= r2:
                    return x[: -len(e)]
            return x

        if suffix == "amente":
            if len(stem) >= r1:
                w = stem
                if (x := drop(w, "iv")) != w:
                    w = drop(x, "at")
                else:
                    w = drop(w, "os", "ic", "ad")
        elif in_r2:
            if suffix in _DELETE:
                w = stem
            elif suffix in _IC:
                w = drop(stem, "ic")
            elif suffix in _OTHER:
                w = stem + _OTHER[suffix]
            elif suffix == "mente":
                w = drop(stem, "ante", "able", "ible")
            elif suffix in ("idad", "idades"):
                w = drop(stem, "abil", "ic", "iv")
            else:
                w = drop(stem, "at")
    if w == start:
        y = _longest(w, _Y, rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            verb = _longest(w, [*_VERB, *_GU], rv)
            if verb:
                w = w[: -len(verb)]
                if verb in _GU and w.endswith("gu") and len(w) - 1 >= rv:
                    w = w[:-1]
    end = _longest(w, ("os", "a", "o", "á", "í", "ó"), rv)
    if end:
        w = w[: -len(end)]
    else:
        end = _longest(w, ("e", "é"), rv)
        if end:
            w = w[:-1]
            if w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter, "lancaster": lancaster, "spanish": spanish}


def _stem_batches(batches: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
    stem = STEMMERS[name]
    for batch in batches:
        yield batch.assign(stem=[stem(t) for t in batch["term"]])


def stem_map(terms: DataFrame, stemmer: str) -> DataFrame:
    """(term, stem) of the distinct terms of ``terms``: the stemmer runs once per word, not once per token."""
    return terms.select("term").distinct().mapInPandas(partial(_stem_batches, name=stemmer), "term string, stem string")


def stem_postings(postings: DataFrame, stemmer: str) -> DataFrame:
    """Postings of stems."""
    stems = stem_map(postings, stemmer)
    return postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))


def compare(terms: DataFrame, stemmers: tuple[str, ...] = ("porter", "lancaster")) -> DataFrame:
    """(stemmer, n_terms, n_stems)."""
    out = None
    for name in stemmers:
        row = stem_map(terms, name).agg(F.lit(name).alias("stemmer"), F.count("*").alias("n_terms"), F.count_distinct("stem").alias("n_stems"))
        out = row if out is None else out.unionByName(row)
    return out
