"""One consistent form for texts that look equal but are stored with different characters.

Strings and code points that look alike form classes, closed transitively by union-find; the most frequent member of a
class in the corpus stands for it; an automaton over all other members rewrites texts, longest match first.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoagraph.operators.skew import PART_ROWS, salted_join
from stoagraph.session import cut

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
}
GREEK = {
    "α": "a", "ϲ": "c", "ϳ": "j", "ο": "o", "ρ": "p", "ν": "v",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
# Letters of further scripts and phonetic letters, each with the Latin letter it looks like.
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "յ": "j", "զ": "q", "ց": "g", "Տ": "S", "Ս": "U", "Օ": "O", "Լ": "L"}
CHEROKEE = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
LISU = {
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T",
    "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
PHONETIC = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ⅼ": "l", "ℓ": "l", "ү": "y", "ʏ": "y", "K": "K"}
# Code points without any mark of their own on the page.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Compatibility forms that look like their plain form; others (superscripts, circled, squared …) look different.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Where such forms are taken from: Latin, punctuation, ligatures, full and half width; elsewhere (as for symbols made
#: of Greek letters) they would join letters that differ. Digraph letters, Roman numerals and digits with a stop look
#: like the letters they are made of.
COMPATIBLE = [(0xA0, 0xA0), (0x132, 0x133), (0x1C7, 0x1CC), (0x2000, 0x206F), (0x2160, 0x217F), (0x2488, 0x249B), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF00, 0xFFEF)]
#: Mathematical letters and digits that differ from plain ones by weight, slant or serifs alone.
MATHEMATICAL = re.compile(r"MATHEMATICAL (?:BOLD|ITALIC|BOLD ITALIC|SANS-SERIF|SANS-SERIF BOLD|SANS-SERIF ITALIC|SANS-SERIF BOLD ITALIC|MONOSPACE) (?:CAPITAL [A-Z]|SMALL [A-Z]|DIGIT [A-Z]+)$")
_SPACES = "             　 "


class _Union:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up.setdefault(a, a)
        self.up[b] = a
        return True


def _spelled(cp: int) -> tuple[str, str] | None:
    """Kind and spelling of a code point's decomposition, one level deep."""
    parts = unicodedata.decomposition(chr(cp)).split()
    if not parts:
        return None
    kind = parts.pop(0) if parts[0][0] == "<" else "canonical"
    return kind, "".join(chr(int(x, 16)) for x in parts)


@lru_cache(1)
def classes() -> dict[str, tuple[str, ...]]:
    """Look-alike classes by root; members are single code points and short strings; the empty string has its own."""
    u = _Union()
    composed: list[tuple[str, str, str]] = []  # code point, base, mark
    for cp in range(0x80, 0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3200 <= cp <= 0x33FF or unicodedata.category(chr(cp)) in ("Cn", "Co", "Cs"):
            continue
        told = _spelled(cp)
        if told is None:
            continue
        kind, text = told
        if kind == "canonical":
            u.join(text, chr(cp))
            if len(text) == 2:
                composed.append((chr(cp), text[0], text[1]))
        elif kind == "<font>" and MATHEMATICAL.match(unicodedata.name(chr(cp), "")):
            u.join(text, chr(cp))
        elif kind in SAME_LOOK and any(lo <= cp <= hi for lo, hi in COMPATIBLE) and (len(text) == 1 or text[0] != " "):
            u.join(text, chr(cp))
    for a, b in (pair for letters in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, PHONETIC) for pair in letters.items()):
        u.join(b, a)
    for ch in _SPACES:
        u.join(" ", ch)
    u.join("-", "‐")
    u.join("-", "‑")
    for ch in INVISIBLE:
        u.join("", ch)
    # letters with a mark look alike if their bases and their marks do; composed bases make this transitive
    changed = True
    while changed:
        changed = False
        by: dict[tuple[str, str], str] = {}
        for ch, base, mark in composed:
            other = by.setdefault((u.find(base), u.find(mark)), ch)
            changed |= u.join(other, ch)
    out: dict[str, list[str]] = defaultdict(list)
    for x in u.up:
        out[u.find(x)].append(x)
    extra: dict[str, set[str]] = defaultdict(set)
    for ch, base, mark in composed:  # every spelling of a marked letter by look-alikes of its base
        for b in out.get(u.find(base), [base]):
            if len(b) == 1:
                extra[u.find(ch)].add(b + mark)
    return {root: tuple(sorted({*members, *extra[root]}, key=_plain)) for root, members in out.items()}


def _plain(x: str) -> tuple:
    """Order of preference where frequency does not decide: nothing, ASCII, fewer code points, lower code points."""
    return (x != "", not x.isascii(), len(x), x)


def patterns() -> tuple[str, ...]:
    return tuple(x for members in classes().values() for x in members if x)


def replacements(frequency: dict[str, int] | None = None) -> dict[str, str]:
    """Pattern to representative, for every member that is not the representative of its class.

    The representative is the member that is most frequent; the plainest of equally frequent ones. Invisible code
    points always stand for nothing. Without frequencies the plainest member is chosen.
    """
    seen = frequency or {}
    out = {}
    for members in classes().values():
        chosen = "" if "" in members else min(members, key=lambda x: (-seen.get(x, 0), _plain(x)))
        out |= {x: chosen for x in members if x != chosen}
    return out


def _touched(patterns: Iterable[str]) -> re.Pattern:
    """Finds the last non-ASCII characters of patterns: one bitmap for the basic plane; any character beyond it counts as one of them."""
    needed = {next(c for c in reversed(x) if not c.isascii()) for x in patterns if not x.isascii()}
    return re.compile("[" + "".join(re.escape(c) for c in sorted(needed) if c < "\uffff") + "]|[\U00010000-\U0010ffff]")


class Rewriter:
    """Rewrites texts by a table of replacements, longest match first, until nothing changes.

    Canonically equal texts are made equal first, so marks on one letter may stand in any order that means the same.
    """

    #: Chains of replacements are as long as the marks on one letter; texts settle in two or three passes.
    PASSES = 50

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.ascii = [x for x in table if x.isascii()]
        # no pattern goes beyond a blank unless it holds one, so a text is rewritten word by word and repeated words once
        self.whole = bool(self.ascii) or any(" " in x for x in table)
        self.known: dict[str, str] = {}
        # a text without the last non-ASCII character of any pattern holds no pattern
        self.touched = _touched(table)
        self.automaton = ahocorasick.Automaton()
        for x, y in table.items():
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if self.whole:
            return self._settled(text)
        if text.isascii() or not self.touched.search(text) and unicodedata.is_normalized("NFC", text):
            return text
        parts = text.split(" ")
        for i, part in enumerate(parts):
            if not part.isascii():
                known = self.known.get(part)
                if known is None:
                    if len(self.known) > 50_000:
                        self.known.clear()
                    known = self.known[part] = self._settled(part)
                parts[i] = known
        return " ".join(parts)

    def _settled(self, text: str) -> str:
        for _ in range(self.PASSES):
            plain = text.isascii()
            base = text if plain or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
            if not any(x in base for x in self.ascii) and (plain or not self.touched.search(base)):
                return base
            out, at = [], 0
            for end, (n, y) in self.automaton.iter_long(base):
                out += (base[at : end - n + 1], y)
                at = end + 1
            new = "".join(out) + base[at:]
            if new == text:
                break
            text = new
        return text


@lru_cache(1)
def plain_rewriter() -> Rewriter:
    """The rewriter to the plainest members, for comparisons that need no corpus."""
    return Rewriter(replacements())


def _count_ascii(codes: np.ndarray, strings: list[str], into: Counter) -> None:
    """Count ASCII strings of two and more characters in one array of code points, by their first pairs."""
    low = codes < 128
    pairs = np.where(low[:-1] & low[1:], codes[:-1] * 128 + codes[1:], 0)
    seen = np.bincount(pairs, minlength=1 << 14)
    for x in strings:
        pair = ord(x[0]) * 128 + ord(x[1])
        if len(x) == 2:
            into[x] += int(seen[pair])
        elif seen[pair]:
            at = np.flatnonzero(pairs == pair)
            at = at[at + len(x) <= len(codes)]
            for j, c in enumerate(x[2:], 2):
                at = at[codes[at + j] == ord(c)]
            into[x] += len(at)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = patterns()
    singles = np.array(sorted(ord(x) for x in known if len(x) == 1), dtype=np.uint32)
    short = [x for x in known if len(x) > 1 and x.isascii()]
    longer = [x for x in known if len(x) > 1 and not x.isascii()]
    touched = _touched(longer)
    automaton = ahocorasick.Automaton()
    for x in longer:
        automaton.add_word(x, x)
    automaton.make_automaton()
    total = np.zeros(0x110000, dtype=np.int64)
    strings: Counter = Counter()
    for batch in batches:
        texts = [t for t in batch["text"] if t]
        for at in range(0, len(texts), 500):
            whole = "\x00".join(texts[at : at + 500])
            codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            total += np.bincount(codes, minlength=0x110000)[:0x110000]
            _count_ascii(codes, short, strings)
        for word, n in Counter(w for t in texts if not t.isascii() for w in t.split(" ") if not w.isascii()).items():
            if touched.search(word):
                for _, x in automaton.iter(word):
                    strings[x] += n
    rows = [(chr(c), int(total[c])) for c in singles if total[c]] + [(x, n) for x, n in strings.items() if n]
    yield pd.DataFrame(rows, columns=["pattern", "n"])


def pattern_counts(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each member of a class occurs in all texts; counted per partition, then summed.

    Its size is bounded by the number of members (about five thousand), however many texts there are.
    """
    counted = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInPandas(_count_batches, "pattern string, n bigint")
    return {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def consistent_texts(rows: DataFrame, row_id: str, text: str, keep_text: bool = True) -> DataFrame:
    """``(row_id, form_key, text_key[, form])``: the consistent form of every non-null text, with digests of both.

    Empty texts keep the empty form; null texts give no row; the identifier may repeat.
    """
    table = replacements(pattern_counts(rows, text))
    schema = f"row_id {dict(rows.dtypes)[row_id]}, form_key binary, text_key binary" + (", form string" if keep_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(table)

        def digest(x: str) -> bytes:
            return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        for batch in batches:
            forms = [rewrite(t) for t in batch["text"]]
            keys = [digest(x) for x in forms]
            own = [k if f is t or f == t else digest(t) for k, f, t in zip(keys, forms, batch["text"], strict=True)]
            out = pd.DataFrame({"row_id": batch["row_id"], "form_key": keys, "text_key": own})
            yield out.assign(form=forms) if keep_text else out

    picked = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return picked.mapInPandas(run, schema)


def same_look_pairs(forms: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: rows of one form whose texts are different strings.

    Distinct spellings of a form are paired first and then expanded to their rows, so a million copies of one spelling
    beside one other cost a million rows, and a form that all rows share in one spelling gives none. Frequent forms
    and spellings are joined in parts; one row per identifier and text counts.
    """
    forms = cut(forms.select("row_id", "form_key", "text_key"))  # digests alone; the texts are rewritten once
    spellings = forms.select("form_key", "text_key").distinct()
    several = spellings.groupBy("form_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("form_key")
    some = cut(forms.join(several, "form_key").distinct())
    one = some.select("form_key", F.col("text_key").alias("text_a")).distinct()
    pairs = salted_join(one, one.withColumnRenamed("text_a", "text_b"), ["form_key"], part_rows).filter(F.col("text_a") < F.col("text_b")).select("text_a", "text_b")
    a, b = (some.select(F.col("text_key").alias(f"text_{x}"), F.col("row_id").alias(f"row_{x}")) for x in "ab")
    met = salted_join(salted_join(a, pairs, ["text_a"], part_rows, "left"), b, ["text_b"], part_rows, "right")
    return met.filter(F.col("row_a") != F.col("row_b")).select(F.least("row_a", "row_b").alias("id_a"), F.greatest("row_a", "row_b").alias("id_b")).distinct()


if sys.maxunicode != 0x10FFFF:  # pragma: no cover
    raise ImportError("wide code points are needed")
