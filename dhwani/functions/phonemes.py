"""Orthographic clusters and phoneme tokens as column expressions (no Python at run time).

A cluster is a struct: kind ``C`` consonants with what hangs on them, ``V`` standalone vowel, ``P`` any
other character. ``sign`` has three states: null (inherent vowel), ``NO_VOWEL`` (an explicit hasanta) or
the sign. ``stops`` tells characters that end a word; digits and Latin letters do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dhwani.functions import tables as T
from dhwani.functions.text import bind, preprocess

NO_VOWEL = "__NONE__"
BAR = "|"
_C, _V, _S, _D = ("[" + "".join(x) + "]" for x in (T.CONSONANTS, T.VOWELS, T.SIGNS, T.MARKS))
CLUSTER = f"(?s)({_C}(?:{T.HASANTA}{_C})*{T.HASANTA}?{_S}?{T.NASAL}?{_D}?|{_V}{T.NASAL}?{_D}?|.)"
YA, HA, AA, E_SIGN, O_SIGN, RI_SIGN = "য", "হ", "া", "ে", "ো", "ৃ"


def _lookup(table: dict) -> Column:
    """A map literal, folded from two strings; values are strings, or lists joined by a space."""
    values = (v if isinstance(v, str) else " ".join(v) for v in table.values())
    return F.map_from_arrays(*[F.split(F.lit("\t".join(x)), "\t") for x in (table, values)])


def _letter(table: dict[str, str], letter: Column) -> Column:
    """What a table of single letters has for a letter, or null."""
    return F.get(F.split(F.lit("\t".join(table.values())), "\t"), F.instr(F.lit("".join(table)), letter) - 1)


def _cluster(raw: Column) -> Column:
    first = F.substring(raw, 1, 1)
    kind = F.when(first.isin(*T.CONSONANTS), "C").when(first.isin(*T.VOWELS), "V").otherwise("P")
    letters = F.regexp_extract(raw, f"^({_C}(?:{T.HASANTA}{_C})*)", 1)
    tail = F.regexp_replace(raw, f"^{_C}(?:{T.HASANTA}{_C})*", "")
    sign = F.regexp_extract(tail, _S, 0)
    mark = F.regexp_extract(raw, f"{_D}$", 0)
    consonant, other = first.isin(*T.CONSONANTS), kind == "P"
    return F.struct(
        kind.alias("kind"), raw.alias("raw"),
        F.when(consonant, F.split(letters, T.HASANTA)).otherwise(F.array().cast("array<string>")).alias("cons"),
        F.when(consonant, F.when(sign != "", sign).when(tail.startswith(T.HASANTA), NO_VOWEL)).alias("sign"),
        F.when(kind == "V", first).alias("vowel"),
        (~other & raw.contains(T.NASAL)).alias("nasal"),
        F.when(~other & (mark != ""), mark).alias("diac"),
        F.when(other, raw).alias("ch"),
        (other & ~raw.rlike(r"^[\p{L}\p{N}]$")).alias("stops"),
    )


def clusters(text: Column) -> Column:
    """Array of clusters of a preprocessed text; joined ``raw`` gives the text back."""
    return F.transform(F.regexp_extract_all(text, F.lit(CLUSTER), 1), _cluster)


class At:
    """Predicates on the cluster at a place of an array, from its neighbours."""

    def __init__(self, all_: Column, i: Column):
        self.all, self.i = all_, i

    def get(self, k: int) -> Column:
        return F.get(self.all, (self.i + k).cast("int"))

    def initial(self, k: int = 0) -> Column:
        return F.coalesce(self.get(k - 1)["stops"], F.lit(True))

    def final(self, k: int = 0) -> Column:
        return F.coalesce(self.get(k + 1)["stops"], F.lit(True))

    def explicit(self, k: int) -> Column:
        sign = self.get(k)["sign"]
        return F.coalesce(sign.isNotNull() & (sign != NO_VOWEL), F.lit(False))

    def real(self, k: int) -> Column:
        return F.coalesce(self.get(k)["kind"] != "P", F.lit(False))

    def last_in(self, k: int, letters: list[str]) -> Column:
        return F.coalesce(F.try_element_at(self.get(k)["cons"], F.lit(-1)).isin(letters), F.lit(False))

    def harmony(self) -> Column:
        """The next syllable has a high front vowel."""
        n = self.get(1)
        return F.coalesce(F.when(n["kind"] == "V", n["vowel"].isin(T.FRONT_VOWELS)).otherwise(n["sign"].isin(T.FRONT_SIGNS)), F.lit(False))

    def penultimate(self) -> Column:
        """Before a final bare sonorant, after a bare or long-a consonant, not at the word's beginning."""
        p = self.get(-1)
        return ~self.initial() & self.real(1) & self.final(1) & ~self.explicit(1) & self.last_in(1, T.FINAL_SONORANTS) & F.coalesce(
            (F.size(p["cons"]) == 1) & (p["sign"].isNull() | p["sign"].isin(NO_VOWEL, AA)), F.lit(False))

    def open_e(self) -> Column:
        """The e sign of a word's first syllable is open."""
        n = self.get(1)
        return (
            F.when(~self.initial() | ~self.real(1), False).when(n["kind"] == "V", False)
            .when(F.coalesce(n["sign"].isin(AA, O_SIGN), F.lit(False)) & self.final(1), True)
            .when(self.explicit(1), False).when(self.final(1), False).otherwise(self.last_in(1, T.OPEN_SONORANTS))
        )

    def keeps_vowel(self) -> Column:
        """The inherent vowel is spoken."""
        return (
            F.when(self.initial(), True).when(self.final(), F.size(self.get(0)["cons"]) > 1).when(~self.real(1), True)
            .when(self.explicit(1), False).when(F.size(self.get(1)["cons"]) > 1, True).otherwise(self.final(1))
        )

    def before_explicit(self) -> Column:
        """Not at the beginning, and the next consonants carry a vowel sign (used by risk flags only)."""
        return ~self.initial() & F.coalesce(self.get(1)["kind"] == "C", F.lit(False)) & self.explicit(1)

    def _ya_aa(self, k: int) -> Column:
        c = self.get(k)
        return F.coalesce((F.array_join(c["cons"], T.HASANTA) == YA) & (c["sign"] == AA), F.lit(False))

    def _hasanta(self, k: int) -> Column:
        return F.coalesce(self.get(k)["ch"] == T.HASANTA, F.lit(False))

    def absorbed(self) -> Column:
        """A word-initial vowel that a following ya with long a takes over."""
        return self.initial() & F.when(self._hasanta(1), self._ya_aa(2)).otherwise(self._ya_aa(1))

    def absorbing(self) -> Column:
        """That ya."""
        vowel = lambda k: F.coalesce(self.get(k)["kind"] == "V", F.lit(False)) & self.initial(k)
        return self._ya_aa(0) & F.when(self._hasanta(-1), vowel(-2)).otherwise(vowel(-1))


def _strings(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<string>")


def _consonant_tokens(at: At, x: Column) -> Column:
    none, one = _strings(), lambda v: F.array(v if isinstance(v, Column) else F.lit(v))
    spelled = F.array_join(x["cons"], T.HASANTA)
    many, ends_ya = F.size(x["cons"]) > 1, F.element_at(x["cons"], -1) == YA
    long_ya = F.coalesce((x["sign"] == AA) & many & ends_ya, F.lit(False))
    at_start = {k: v for k, v in (T.CONJUNCTS | T.INITIAL).items()}
    elsewhere = T.CONJUNCTS | T.NOT_INITIAL
    fused = F.split(F.when(at.initial(), F.try_element_at(_lookup(at_start), spelled)).otherwise(F.try_element_at(_lookup(elsewhere), spelled)), " ")
    letters = F.when(long_ya, F.slice(x["cons"], F.lit(1), F.size(x["cons"]) - 1)).otherwise(x["cons"])
    single = F.transform(letters, lambda c: _letter(T.CONSONANTS, c))
    onset = F.when(fused.isNotNull(), fused).when((spelled == HA) & F.coalesce(x["sign"] == RI_SIGN, F.lit(False)), none).otherwise(single)
    inherent = F.when(at.final(), "O").when((F.size(x["cons"]) == 1) & (at.harmony() | at.penultimate()), "O").otherwise("o")
    nucleus = (
        F.when(x["sign"] == NO_VOWEL, none).when(long_ya & at.initial(), one("A"))
        .when(x["sign"] == E_SIGN, one(F.when(at.open_e(), "E").otherwise("e")))
        .when(x["sign"].isNotNull(), one(_letter(T.SIGNS, x["sign"])))
        .when(spelled == T.KHANDA_TA, none).when(spelled.isin(T.INHERENT_A) & at.initial(), one("A"))
        .when(at.keeps_vowel(), one(inherent)).otherwise(none)
    )
    return F.when(at.absorbing(), one("A")).otherwise(F.concat(onset, nucleus))


def _with_marks(tokens: Column, x: Column) -> Column:
    nasal = bind(tokens, lambda a: F.when(x["nasal"] & (F.size(a) > 0), F.concat(
        F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit("~"))))).otherwise(a))
    return F.concat(nasal, F.when(x["diac"].isNotNull(), F.array(_letter(T.MARKS, x["diac"]))).otherwise(_strings()))


def cluster_tokens(all_: Column, i: Column, x: Column) -> Column:
    """Tokens of the cluster ``x`` at place ``i`` of ``all_``."""
    at = At(all_, i)
    vowel = F.when(at.absorbed(), _strings()).otherwise(_with_marks(F.array(_letter(T.VOWELS, x["vowel"])), x))
    space = F.when(x["ch"].rlike(f"^{T.WS}$"), F.array(F.lit(BAR))).otherwise(_strings())
    return F.when(x["kind"] == "P", space).when(x["kind"] == "V", vowel).otherwise(_with_marks(_consonant_tokens(at, x), x))


def tokens_of(found: Column) -> Column:
    """Phoneme tokens of an array of clusters."""
    return bind(found, lambda a: F.flatten(F.transform(a, lambda x, i: cluster_tokens(a, i, x))))


def phonemes(text: Column, exact_nfc: bool = False) -> Column:
    """Array of phoneme tokens of a text; every white space gives a bar."""
    return tokens_of(clusters(preprocess(text, exact_nfc)))


def readable(tokens: Column) -> Column:
    return F.array_join(tokens, " - ")


def risks(text: Column) -> Column:
    """Array of (pos, rule, code, detail) of spellings whose pronunciation is uncertain."""

    def of(a: Column, x: Column, i: Column) -> Column:
        at = At(a, i)
        spelled = F.array_join(x["cons"], T.HASANTA)
        single, bare = F.size(x["cons"]) == 1, x["sign"].isNull()
        rules = (
            ("unrecognized_conjunct", (F.size(x["cons"]) > 1) & F.try_element_at(_lookup(dict.fromkeys(T.CONJUNCTS, "")), spelled).isNull()),
            ("word_final_schwa_drop", bare & at.final() & single),
            ("suppressed_schwa", bare & single & ~at.final() & at.before_explicit()),
            ("sa_sh_or_s_ambiguous", F.array_contains(x["cons"], "স")),
        )
        flag = lambda n, code, cond: F.when((x["kind"] == "C") & cond, F.struct(i.alias("pos"), F.lit(n).alias("rule"), F.lit(code).alias("code"), spelled.alias("detail")))
        return F.filter(F.array(*[flag(n + 1, code, cond) for n, (code, cond) in enumerate(rules)]), lambda f: f.isNotNull())

    return bind(clusters(preprocess(text)), lambda a: F.flatten(F.transform(a, lambda x, i: of(a, x, i))))
