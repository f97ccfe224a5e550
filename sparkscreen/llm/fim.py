"""Fill-in-the-middle transformation: a text's middle goes to its end, between sentinels, so that a model learns to fill gaps.

A text is cut at two ranks among its units (lines, words or characters). One Aho-Corasick automaton, run once over a text,
finds the ASCII characters at which units end and the sentinels. Only these events are looked at: between two of them lies
a gap in which units follow by arithmetic (as many as characters if each is a unit, else none ends), so a rank's place is
an event's place. Ranks, form and cuts come from the SHA-256 of seed and id, so that a lost task does the same again.

Forms, with the sentinels P, S, M: psm is P prefix S suffix M middle; spm is S suffix P prefix M middle; plain is the text.
restore() turns output and form into the text again, whatever the cuts were: no sentinel occurs in a text that is cut, and
sentinels that could overlap each other are refused.

Nulls: a null text is an empty one, which stays plain; a null id counts as an empty id. Texts are taken whole, one at a
time, however long. Repeated rows have the same id and text, so the same output. Input columns named like the results are
replaced; all others stay. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: The ASCII characters at which a unit may end: after each, or after a run of them, or (none) after every character.
EVENTS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")
CUT = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("sentinel", pa.bool_())])


def check(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels of which one may begin in another: then output could not be taken apart again."""
    ends = lambda a: {a[i:] for i in range(len(a))}
    heads = lambda a: {a[: i + 1] for i in range(len(a))}
    for (i, a), (j, b) in product(enumerate(sentinels), repeat=2):
        if not a or (i != j and (a in b or ends(a) & heads(b))) or (i == j and (ends(a) & heads(a)) - {a}):
            raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


class Scanner:
    """The automaton of a kind of unit and of the sentinels."""

    def __init__(self, unit: str, sentinels: tuple[str, ...]):
        self.unit, self.automaton = unit, ahocorasick.Automaton()
        for c in EVENTS[unit]:
            self.automaton.add_word(c, True)
        for s in sentinels:
            self.automaton.add_word(s, False)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[list[int], bool]:
        """(places after which a unit may end, whether a sentinel occurs)."""
        places, sentinel = [], False
        for at, ends in self.automaton.iter(text):
            if ends:
                places.append(at + 1)
            else:
                sentinel = True
        return places, sentinel

    def cut(self, text: str, ranks: tuple[int, int]) -> tuple[int, int, int, bool]:
        """(units, end of the prefix, end of the middle, whether a sentinel occurs); ranks are taken modulo units + 1."""
        ends, sentinel = self.events(text)
        if self.unit == "word":  # of a run of white space, its last; at the text's end, the end itself
            ends = [p for p, after in zip(ends, [*ends[1:], 0]) if after != p + 1]
        if self.unit == "char":
            n, place = len(text), lambda k: k
        else:
            ends += [len(text)] * (bool(text) and ends[-1:] != [len(text)])
            n, place = len(ends), lambda k: ends[k - 1] if k else 0
        low, high = sorted(r % (n + 1) for r in ranks)
        return n, place(low), place(high), sentinel


_SCANNERS: dict[tuple, Scanner] = {}


def _cutter(unit: str, sentinels: tuple[str, ...]):
    @F.arrow_udf("struct<n: bigint, first: bigint, second: bigint, sentinel: boolean>")
    def cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        scanner = _SCANNERS.get((unit, sentinels)) or _SCANNERS.setdefault((unit, sentinels), Scanner(unit, sentinels))
        rows = [scanner.cut(t.as_py(), (x, y)) for t, x, y in zip(text, a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array([dict(zip(CUT.names, r)) for r in rows], CUT)

    return cut


def number(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th group of eight hex digits of the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int, rate: int = 100, spm: int = 50, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with n_units, form, prefix_chars, middle_chars (null if plain) and output. Of 100 texts, rate are cut; of 100 cut ones, spm are spm."""
    check(sentinels)
    p, s, m = map(F.lit, sentinels)
    whole, cut = F.coalesce(F.col(text), F.lit("")), F.col("__cut")
    size = (cut["second"] - cut["first"]).cast("int")
    prefix, middle, suffix = F.substring(F.col("__text"), F.lit(1), cut["first"].cast("int")), F.substring(F.col("__text"), (cut["first"] + 1).cast("int"), size), F.substring(F.col("__text"), (cut["second"] + 1).cast("int"), F.length("__text"))
    plain = (F.col("__text") == "") | cut["sentinel"] | (F.pmod(number(seed, F.col(doc_id), 2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(number(seed, F.col(doc_id), 3), F.lit(100)) < spm, "spm").otherwise("psm")
    results = {
        "n_units": cut["n"],
        "form": F.col("__form"),
        "prefix_chars": F.when(F.col("__form") != "plain", cut["first"]),
        "middle_chars": F.when(F.col("__form") != "plain", cut["second"] - cut["first"]),
        "output": F.when(F.col("__form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("__form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("__text")),
    }
    found = docs.withColumn("__text", whole).withColumn("__cut", _cutter(unit, sentinels)(F.col("__text"), number(seed, F.col(doc_id), 0), number(seed, F.col(doc_id), 1)))
    kept = [F.col(c) for c in docs.columns if c not in RESULTS]
    return found.withColumn("__form", form).select(*kept, *(c.alias(name) for name, c in results.items()))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that output was made of."""
    p, s, m = sentinels
    inner = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, m, -1)
    psm, spm = F.concat(inner(p, s), last, inner(s, m)), F.concat(inner(p, m), last, inner(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
