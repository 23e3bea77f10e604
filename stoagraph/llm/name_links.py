"""Spellings of one person or organisation, linked by a pigeonhole segment join on their name parts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoagraph.operators.skew import lookup_join, salted_join
from stoagraph.session import cut

# Given names with short and pet forms that no rule makes of them; a general table, to be replaced by one's own.
NICKNAMES = {
    "abigail": "gail nabby", "agnes": "aggie nessie nancy", "albert": "bert", "alexander": "sandy alec sasha xander lex", "alfred": "fred", "alice": "lisa elsie", "amelia": "millie", "andrew": "drew andy",
    "ann": "nan nancy annie", "anthony": "tony", "antonio": "toni tonio", "archibald": "archie baldie", "arthur": "art", "augustus": "gus", "barbara": "babs bobbie", "bartholomew": "bat tolly",
    "beatrice": "trixie bea", "bernard": "barney", "bridget": "biddy bride", "caroline": "carrie lina", "cecilia": "cissy sissy celia", "charles": "chuck chaz carl karl charley", "charlotte": "lottie", "christina": "tina kirsten",
    "christopher": "kit topher", "clarence": "clancy", "cornelius": "neil", "cynthia": "cindy", "deborah": "debby", "dominic": "nick", "dorothy": "dolly dot dottie dodie dora", "edith": "edie", "edmund": "ned ted",
    "edward": "ted teddy ned", "edwin": "ned", "eleanor": "nell nelly nora ella ellie lenore", "elizabeth": "betty beth betsy bess bessie libby lisa liza lizzie liz lisbeth elsie", "emily": "millie emmy", "ernest": "ernie",
    "eugene": "gene", "evelyn": "eve", "ferdinand": "nando ferdy", "florence": "flossie flo", "frances": "fanny fran", "francis": "frank frankie fritz", "franz": "fritz", "frederick": "fritz rick", "friedrich": "fritz",
    "geoffrey": "jeff", "george": "jorge dodie", "gerald": "jerry", "gertrude": "trudy trudie", "gottfried": "friedel götz", "gregory": "grigor", "harold": "hal harry", "heinrich": "heinz heiner hinz", "helen": "nell nelly ellen lena",
    "henrietta": "hetty etta", "henry": "harry hank hal", "herbert": "bert", "hubert": "bert", "ignacio": "nacho", "isaac": "ike", "isabella": "bella ibby", "jacob": "jake", "james": "jim jimmy jamie jem", "jane": "jenny",
    "jean": "jeannot", "johannes": "hans hannes", "john": "jack jackie johnny jno ian", "jonathan": "nathan", "joseph": "joe joey beppe sepp", "josé": "pepe", "julia": "jill", "katherine": "kitty kit kate katie kay kathy trina",
    "konrad": "kurt konni conny", "laurence": "larry lars", "lawrence": "larry lars laurie", "leonard": "lenny", "leonor": "nora", "louis": "lewis lou", "lucas": "luke", "ludwig": "lutz", "magdalena": "lena", "manuel": "manolo",
    "margaret": "peggy peg meg maggie madge daisy greta gretchen rita maisie mamie", "maria": "mitzi", "martha": "patty matty", "mary": "molly polly mamie minnie may", "matilda": "tilda tilly maud", "michael": "mick micky mickey mike mikey",
    "mildred": "millie", "nathaniel": "nat nate", "nicholas": "nick nicky klaus claus colin", "oliver": "noll", "ottilie": "tilly", "patricia": "tricia trish patsy", "patrick": "paddy", "penelope": "nell", "peter": "piers pete",
    "philip": "pip", "rebecca": "becky becca beck", "reginald": "rex", "richard": "dick rick ricky dickie hick", "robert": "bob bobby rob bert rupert", "roger": "hodge", "ronald": "ron", "rosemary": "romy", "rudolf": "rolf", "samuel": "sammy",
    "sarah": "sally sadie", "sebastian": "bastian", "sigmund": "siggi", "simone": "mona", "sophia": "fifi", "stephen": "steve steven", "susanna": "sukie sanna sue", "theodore": "ted teddy", "theresa": "tess terry", "thomas": "tom tommy",
    "timothy": "tim", "ulrich": "uli", "ursula": "uschi ulla", "valentine": "val", "victoria": "vicky", "vincent": "vin", "virginia": "ginny", "walter": "wat", "wilhelm": "willem helmut", "wilhelmina": "mina minna willa wilma billie helma",
    "william": "bill billy liam", "winifred": "freda", "zachary": "zack",
}
# What stands before or after a name without being part of it.
TITLES = set("prof professor dr sir rev reverend mr mrs ms lord lady dame st saint fr father".split())
PARTICLES = set("de van von der den del di da la le du of ter zu zum al ibn bin".split())
SUFFIXES = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "sr": "sr", "jr": "jr", "senior": "sr", "junior": "jr", "elder": "sr", "younger": "jr"}
# Letters that stand for one sound in different romanisations, in the order of their replacement.
SOUNDS = [("sch", "sh"), ("ph", "f"), ("ck", "k"), ("ch", "\x00"), ("c", "k"), ("\x00", "ch"), ("qu", "kv"), ("w", "v"), ("x", "ks"), ("ou", "u"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("ei", "ai"), ("ey", "ai"), ("ay", "ai"), ("y", "i")]
_DIGIT_LETTERS = str.maketrans("013456", "oleasg")


def fold(text: str) -> str:
    """Lower case without accents; ß and ligatures spelled out."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_GIVEN = {fold(k) for k in NICKNAMES}
_SHORT: dict[str, set[str]] = {}
for _full, _all in NICKNAMES.items():
    for _s in _all.split():
        _SHORT.setdefault(fold(_s), set()).add(fold(_full))
@lru_cache(100_000)
def sound(word: str) -> str:
    """A last name in one romanisation: Tiwastutuw and Tivastutouv are one."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return word


_PET_ENDINGS = ("y", "ie", "i", "ey", "e", "s", "sy")
_OTHER_NAME_ENDINGS = ("a", "e", "ina", "ine", "ette", "elle", "ella", "le", "la", "ia")


@lru_cache(100_000)
def is_short_of(short: str, full: str) -> bool:
    """Whether one given name is a short form of another: by the table, or as its beginning, its contraction, or a pet form of its beginning.

    Thos. and Wm. are a beginning and the last letters; Jenny and Willy a beginning, perhaps doubled, and a pet ending.
    A name and what only adds the ending of another name (Simon, Simone) are two names.
    """
    if short == full or len(full) < 4:
        return False
    if full in _SHORT.get(short, ()):
        return True
    if len(short) < 2 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return full[len(short) :] not in _OTHER_NAME_ENDINGS
    if len(short) <= len(full) - 2 and any(full.startswith(short[:-j]) and full.endswith(short[-j:]) for j in (1, 2) if len(short) > j):
        return True
    for end in _PET_ENDINGS:
        stem = short.removesuffix(end)
        if stem != short and 3 <= len(stem) <= len(full) - 2 and (full.startswith(stem) or stem[-1] == stem[-2] and full.startswith(stem[:-1])):
            return True
    return False


@lru_cache(100_000)
def stands_for(given: str) -> frozenset[str]:
    """Full given names of the table that a given name, or a short form of the table with one typo, stands for."""
    out = set(_SHORT.get(given, ())) | ({given} if given in _GIVEN else set())
    if len(given) >= 4:
        for short, full in _SHORT.items():
            if len(short) >= 4 and osa_within(given, short, 1) <= 1:
                out |= full
    return frozenset(out)


@lru_cache(100_000)
def full_forms(given: str) -> frozenset[str]:
    """Names of the table that a given name is a short form of, by the table or by rule."""
    return frozenset(_SHORT.get(given, ())) | {x for x in _GIVEN if is_short_of(given, x)}


def osa_within(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours if at most ``most``, else ``most + 1``; only a diagonal band is computed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before2: list[int] = []
    before = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        low = far
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row[j] = d if d < far else far
            low = min(low, row[j])
        if low > most and min(before) > most:
            return far
        before2, before = before, row
    return min(before[len(b)], far)


class Name:
    """The parts of a name: words in order with initials apart, the words before a comma moved behind, and a suffix."""

    __slots__ = ("words", "suffix", "n_full", "known_last", "levels")

    def __init__(self, text: str, levels: dict[str, int] | None = None) -> None:
        bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
        bare = re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", "", bare)  # a hyphen inside a word
        sides = [s for s in bare.split(",") if s.strip()]
        self.suffix = ""
        parts: list[list[str]] = []
        for k, side in enumerate(sides):
            raw = re.findall(r"[^\W_]+[.]?", side)
            side_words = []
            for i, w in enumerate(raw):
                plain = fold(w.rstrip(".")).translate(_DIGIT_LETTERS) if not w.rstrip(".").isdigit() else w
                dotted = w.endswith(".")
                end = i == len(raw) - 1
                if end and (len(raw) > 1 or k) and plain in SUFFIXES and not (dotted and plain in ("i", "ii", "iii", "iv")) and not (plain == "i" and k and len(raw) == 1):
                    self.suffix = SUFFIXES[plain]
                elif plain in TITLES and (len(plain) > 2 or dotted or plain in ("dr", "mr", "ms", "st", "fr")) and not side_words and k == 0:
                    continue
                elif plain in PARTICLES or plain == "the":
                    continue
                elif len(w.rstrip(".")) == 2 and w.isupper() and not dotted and not text.isupper():
                    side_words += list(plain)  # two initials written together
                else:
                    side_words.append(plain)
            parts.append(side_words)
        parts = [p for p in parts if p]
        self.known_last = len(parts) == 2
        self.words = tuple(parts[1] + parts[0]) if self.known_last else tuple(w for p in parts for w in p)
        self.n_full = sum(len(w) > 1 for w in self.words)
        self.levels = levels or {}

    def given(self, word: str) -> bool:
        """Whether a word is known as a given name: from the table, or because it stands before many last names."""
        return word in _GIVEN or word in _SHORT or word in self.levels


def given_cost(x: str, y: str, levels_x: dict[str, int] | None = None, levels_y: dict[str, int] | None = None) -> int | None:
    """What it costs to read one given name for another: equal 0, initial or short form 1, one typo 2; None if it can't be.

    Two names of the table are two names, and so are two words that both stand before many last names in the data,
    unless one of them is so much rarer that it is a frequent typo.
    """
    if x == y:
        return 0
    if len(x) == 1 or len(y) == 1:
        return 1 if x[0] == y[0] else None
    by_table = y in _SHORT.get(x, ()) or x in _SHORT.get(y, ())
    if x in _GIVEN and y in _GIVEN and not by_table:
        return None
    if by_table or is_short_of(x, y) or is_short_of(y, x) or full_forms(x) & full_forms(y):
        return 1
    a, b = sorted((x, y), key=len)
    if len(a) >= 3 and osa_within(a, b, 1) <= 1:
        p, q = (levels_x or {}).get(x, 0), (levels_y or {}).get(y, 0)
        return None if p and q and abs(p - q) <= 1 else 2
    for short, full in ((x, y), (y, x)):  # a short form with a typo
        if len(short) >= 4 and full in stands_for(short):
            return 3
    return None


def _sequence_cost(less: tuple[str, ...], more: tuple[str, ...], levels_x: dict[str, int], levels_y: dict[str, int]) -> int | None:
    """Least cost of reading all of ``less``, in order, among ``more``, the first among both being the same."""
    if not less:
        return 3
    if not more:
        return None
    first = given_cost(less[0], more[0], levels_x, levels_y)
    if first is None:
        return None
    total, at = first, 1
    for x in less[1:]:
        best = None
        for k in range(at, len(more)):
            c = given_cost(x, more[k], levels_x, levels_y)
            if c is not None and (best is None or c < best[0]):
                best = (c, k)
        if best is None:
            return None
        total, at = total + best[0], best[1] + 1
    return total + (1 if len(more) > len(less) else 0)


def _readings(n: Name) -> list[tuple[str, tuple[str, ...]]]:
    """Every way to take a last name: ``(last, given names in order)``; also two last words written apart."""
    w = n.words
    if not w:
        return []
    out = []
    if len(w[-1]) > 1:
        out.append((w[-1], w[:-1]))
    if not n.known_last and len(w) > 1 and len(w[0]) > 1 and not n.given(w[0]):
        out.append((w[0], w[1:]))
    # (words behind the first may be parts of a last name even if they are given names elsewhere)
    if len(w) > 2 and len(w[-2]) > 1 and len(w[-1]) > 1 or len(w) == 2 and len(w[0]) > 1 and len(w[1]) > 1 and not n.given(w[0]) and not n.given(w[1]):
        out.append((w[-2] + w[-1], w[:-2]))
    if not n.known_last and len(w) > 2 and len(w[0]) > 1 and len(w[1]) > 1 and not n.given(w[0]):
        out.append((w[0] + w[1], w[2:]))
    for last, given in list(out):  # a particle written together with the last name
        for p in ("von", "van", "de"):
            if last.startswith(p) and len(last) >= len(p) + 7:
                out.append((last[len(p) :], given))
    return out


def reading_cost(less: Name, more: Name, edits: int = 2) -> int | None:
    """Least cost of reading ``less`` as a spelling of ``more``; None if they can't be the same person.

    Their suffixes must agree; the last names may differ by ``edits`` typos (one below eight letters) or in how they are romanised; the given names
    of ``less`` must all be found among those of ``more``, beginning with the first.
    """
    if less.suffix != more.suffix:
        return None
    best = None
    for last_a, given_a in _readings(less):
        for last_b, given_b in _readings(more):
            most = edits if min(len(last_a), len(last_b)) >= 8 else 1 if min(len(last_a), len(last_b)) >= 5 else 0
            d = osa_within(last_a, last_b, most)
            if d > most:
                if min(len(last_a), len(last_b)) < 5 or sound(last_a) != sound(last_b):
                    continue
                d = 1  # another romanisation
            if not given_a and last_b != more.words[-1]:  # a bare last name, against a name turned round
                continue
            g = _sequence_cost(given_a, given_b, less.levels, more.levels)
            if g is None:
                continue
            # one string holds few typos: two in the last name leave none for the given name
            if d >= 2 and g >= 2 and given_a:
                continue
            if best is None or 4 * d + g < best:
                best = 4 * d + g
    return best


#: Mark of last names by sound, which are met exactly and not by close words.
SOUND = "\x01"


def given_tags(given: tuple[str, ...]) -> tuple[set[str], set[str], set[str]]:
    """Tags by which names of one last name meet: as the one that says less, as the one that says more, and the initials it is looked up by.

    No given name asks for all (``*``), an initial for the names it begins; full given names meet if they begin or end
    alike, are one but for a letter, or stand for one name of the table.
    """
    if not given:
        return {"*", "**"}, {"**"}, set()
    first = given[0]
    if len(first) == 1:
        return {f"{first}.", f"{first}{first}."}, {"*", f"{first}{first}."}, {first}
    full = stands_for(first) | full_forms(first)
    like = {f"<{first[:2]}", *(f"={x}" for x in full)}
    if len(first) >= 5:
        like.add(f">{first[-2:]}")
    if len(first) <= 5:
        like |= {f"~{first}", *(f"~{first[:i]}{first[i + 1 :]}" for i in range(len(first)))}
    less = {f"{first[0]}."} if len(first) == 2 else set()
    return like | less, like | {"*", f"{first[0]}."}, {first[0], *(x[0] for x in full)}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, n in zip(batch["name"], batch["n"], strict=True):
            own = Name(name)
            form = "|".join((" ".join(own.words[:-1]), own.words[-1] if own.words else "", own.suffix, "1" if own.known_last else ""))
            form = form if own.words else f"={name}"
            rows.append((name, n, form, 100 * own.n_full + len(own.words), list(own.words)))
        yield pd.DataFrame(rows, columns=["name", "n", "form", "says", "words"])


def given_levels(forms: DataFrame, least: int = 5) -> DataFrame:
    """``(word, level)`` of words known as given names from the data: they stand first before ``least`` last words or more, and
    more than twice as often as they stand last behind others. The level is the logarithm of the number of last words.
    """
    ends = forms.filter(F.size("words") > 1).select(F.col("words")[0].alias("first"), F.element_at("words", -1).alias("last"))
    ends = ends.filter((F.length("first") > 1) & (F.length("last") > 1)).distinct()
    roles = ends.select(F.explode(F.array(F.struct(F.col("first").alias("word"), F.lit(1).alias("f")), F.struct(F.col("last").alias("word"), F.lit(0).alias("f")))).alias("r"))
    counts = roles.groupBy("r.word").agg(F.sum("r.f").alias("first"), F.sum(1 - F.col("r.f")).alias("last"))
    return counts.filter((F.col("first") >= least) & (F.col("first") > 2 * F.col("last"))).select("word", F.floor(F.log2("first")).cast("int").alias("level"))


def with_levels(forms: DataFrame, levels: DataFrame) -> DataFrame:
    """Add ``levels``, a map of those words of a form that are known as given names."""
    words = forms.select("form", F.explode(F.array_distinct("words")).alias("word"))
    known = lookup_join(words, "word", levels).groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("word", "level"))).alias("levels"))
    return forms.join(known, "form", "left")


def _tagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last names of every form with the tags of their given names, and the initials to look the last names up by."""
    for batch in batches:
        rows = []
        for form, name, levels in zip(batch["form"], batch["name"], batch["levels"], strict=True):
            own = Name(name, dict(levels) if levels is not None else None)
            for last, given in set(_readings(own)):
                less, more, initials = given_tags(given)
                rows.append((form, last, sorted(less), sorted(more), sorted(initials)))
                if len(last) >= 5:  # met exactly, by sound
                    rows.append((form, f"{SOUND}{sound(last)}", sorted(less), sorted(more), []))
        yield pd.DataFrame(rows, columns=["form", "word", "less", "more", "initials"])


def segments(word: str, k: int) -> list[tuple[int, int]]:
    """Starts and lengths of the ``k + 1`` segments of a word, as equal as can be."""
    size, longer = divmod(len(word), k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - longer)
        out.append((at, n))
        at += n
    return out


def most_edits(length: int, k: int) -> int:
    """Edits allowed between words the shorter of which has ``length`` letters: ``k`` from eight on, one from three on."""
    return k if length >= 8 else min(k, 1) if length >= 3 else 0


def segment_keys(word: str, k: int) -> set[tuple[int, int, str]]:
    """Index keys ``(length, number, characters)`` of a word: its segments, and those it has with two letters across a border exchanged.

    An edit spoils one segment, but a transposition across a border spoils two; with the letters exchanged back it
    spoils none, so that one of k+1 segments is whole for every word within k edits, transpositions counted as one.
    """
    own = most_edits(len(word), k)
    cuts = segments(word, own)
    keys = set()
    for border in [None, *(at for at, n in cuts[1:] if at and n)]:
        w = word if border is None else word[: border - 1] + word[border] + word[border - 1] + word[border + 1 :]
        keys.update((len(w), i, w[at : at + n]) for i, (at, n) in enumerate(cuts) if n)
    return keys


def probe_keys(word: str, k: int, longer: bool = False) -> set[tuple[int, int, str]]:
    """All keys under which words within ``k`` edits can stand in the index: shifted substrings for every length, up to
    the word's own or, with ``longer``, beyond it.
    """
    keys = set()
    for size in range(max(1, len(word) - k), len(word) + (k if longer else 0) + 1):
        allowed = most_edits(min(size, len(word)), k)
        if abs(len(word) - size) > allowed:
            continue
        for i, (at, n) in enumerate(segments("x" * size, most_edits(size, k))):
            if n:
                keys.update((size, i, word[p : p + n]) for p in range(max(0, at - allowed), min(len(word) - n, at + allowed) + 1))
    return keys


def close_words(words: DataFrame, k: int = 2, part_rows: int = 5_000) -> DataFrame:
    """``(word, other)``, ``word < other``: words within ``k`` edits (one below eight letters), found by the pigeonhole principle.

    A word is cut into k+1 segments; a word within k edits holds one of them whole, moved by k places at most (see
    ``segment_keys`` for transpositions). Segments form the inverted index, keyed by class, length, number and characters; substrings of
    the other words at every shift that the lengths allow are looked up in it; the banded distance verifies.
    ``words`` may have a column ``cls`` (array): then only words that share a class meet, and words with the class ``*``
    meet all. Keys with more than ``part_rows`` words are joined in parts.
    """
    has_class = "cls" in words.columns
    # one word becomes about a hundred keys, so words are spread before they do
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.select("word", ("cls" if has_class else F.array(F.lit("")).alias("cls"))).repartition(spread, F.xxhash64("word"))

    def emit(probing: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for w, own in zip(batch["word"], batch["cls"], strict=True):
                    kinds = [c for c in own if c != "*"] + (["?"] if has_class and not probing else [])
                    if kinds:
                        out += [(c, *key, w) for key in (probe_keys(w, k) if probing else segment_keys(w, k)) for c in kinds]
                    if probing and "*" in own:  # sought among all words, longer ones too
                        out += [("?", *key, w) for key in probe_keys(w, k, longer=True)]
                yield pd.DataFrame(out, columns=["cls", "size", "seg", "part", "w"])

        return run

    schema = "cls string, size int, seg int, part string, w string"
    # (keys as numbers: two keys of one number only make a candidate more)
    key = F.xxhash64("cls", "size", "seg", "part").alias("key")
    index = cut(rows.mapInPandas(emit(False), schema).select(key, F.col("w").alias("word")))
    probes = rows.mapInPandas(emit(True), schema).select(key, F.col("w").alias("other"))
    # k edits with transpositions are 2k without: built-in code drops nearly all candidates before they are made distinct
    near = F.levenshtein("word", "other", 2 * k) >= 0
    met = salted_join(probes, index, ["key"], part_rows, "right")
    met = met.filter((F.col("word") != F.col("other")) & near).select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")).distinct()

    @F.pandas_udf(T.BooleanType())
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        most = [most_edits(min(len(x), len(y)), k) for x, y in zip(a, b, strict=True)]
        return pd.Series([osa_within(x, y, m) <= m for x, y, m in zip(a, b, most, strict=True)], dtype=bool)

    return met.filter(verified("word", "other"))


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def either(x: Name, y: Name) -> int | None:
        return min((c for c in (reading_cost(x, y), reading_cost(y, x)) if c is not None), default=None)

    for batch in batches:
        memo: dict[str, Name] = {}

        def name(x: str, levels, memo: dict[str, Name] = memo) -> Name:
            if x not in memo:
                memo[x] = Name(x, dict(levels) if levels is not None else None)
            return memo[x]

        cost = [either(name(a, p), name(b, q)) for a, p, b, q in zip(batch["name"], batch["levels"], batch["parent_name"], batch["parent_levels"], strict=True)]
        yield batch[["form", "parent", "says", "n"]].assign(cost=pd.Series(cost, dtype="Int32", index=batch.index)).dropna(subset=["cost"])


def linked_names(rows: DataFrame, name: str, k: int = 2, part_rows: int = 5_000) -> DataFrame:
    """``(name, entity, n)``: every distinct non-blank name with the name that stands for its entity.

    Copies are counted first; names whose parts are equal are one form. Every form points to the form it is most
    cheaply read as, among those that say more (more full words, more words, more rows, then more letters), and forms that point to one another
    in the end are one entity; so a bare or misspelled name follows its best reading only and never joins two people.
    Forms meet if they share a close last name and a tag of the given name, so candidates grow with the forms, not with
    the square of the forms of one last name. Null and blank names are left out; names without any letters are each an
    entity of their own.
    """
    distinct = rows.select(F.col(name).alias("name")).filter(F.col("name").rlike(r"\S")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = cut(distinct.mapInPandas(_parse, "name string, n bigint, form string, says int, words array<string>"))
    forms = parsed.groupBy("form").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.sum("n").alias("n"), F.first("says").alias("says"), F.first("words").alias("words"))
    forms = cut(with_levels(forms, given_levels(forms)).drop("words"))
    tagged = cut(forms.select("form", "name", "levels").mapInPandas(_tagged, "form string, word string, less array<string>, more array<string>, initials array<string>"))
    lone = F.array_contains("less", "*")
    classes = tagged.filter(~F.col("word").startswith(SOUND)).withColumn("c", F.explode(F.when(lone, F.array(F.lit("*"))).otherwise(F.col("initials")))).groupBy("word").agg(F.collect_set("c").alias("cls"))
    near = cut(close_words(classes, k, part_rows))
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other")))
    less = tagged.select("form", "word", F.explode("less").alias("tag"))
    moved = salted_join(less, both, ["word"], part_rows).select("form", F.col("other").alias("word"), "tag")
    more = tagged.select(F.col("form").alias("parent"), "word", F.explode("more").alias("tag"))
    met = salted_join(less.unionByName(moved), more, ["word", "tag"], part_rows, "right").filter(F.col("form") != F.col("parent")).select("form", "parent").distinct()
    rank = F.struct("says", "n", F.length("form"), "form").alias("rank")
    own = forms.select("form", rank, "name", "levels", "says", "n")
    a, b = own.alias("a"), own.alias("b")
    pairs = met.join(a, met["form"] == F.col("a.form")).join(b, met["parent"] == F.col("b.form")).select(
        *(F.when(F.col("a.rank") < F.col("b.rank"), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(alias)
          for x, y, c, alias in (("a", "b", "form", "form"), ("a", "b", "name", "name"), ("a", "b", "levels", "levels"), ("b", "a", "form", "parent"),
                                 ("b", "a", "name", "parent_name"), ("b", "a", "levels", "parent_levels"), ("b", "a", "says", "says"), ("b", "a", "n", "n")))
    )
    pairs = cut(pairs.mapInPandas(_costs, "form string, parent string, says int, n bigint, cost int"))
    best = pairs.groupBy("form").agg(F.min_by("parent", F.struct("cost", -F.col("says"), -F.col("n"), "parent")).alias("parent"), F.min("cost").alias("cost"))
    roots = cut(forms.select("form").join(best.select("form", "parent"), "form", "left").select("form", F.coalesce("parent", "form").alias("root")))
    while True:  # every pass doubles the length of the chains that are followed
        up = roots.select(F.col("form").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(up, "root").select("form", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        roots = moved.select("form", "root")
        if moved.filter("moved").isEmpty():
            break
    entity = forms.select(F.col("form").alias("root"), F.col("name").alias("entity"))
    return parsed.select("name", "n", "form").join(roots, "form").join(entity, "root").select("name", "entity", "n")


def name_pairs(linked: DataFrame, part_names: int = 2000) -> DataFrame:
    """Every pair of distinct names of one entity, the lesser first; entities of very many names are joined in parts."""
    parts = linked.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / part_names).cast("int").alias("parts"))
    own = linked.select("entity", "name").join(parts, "entity")
    a = own.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).alias("a")
    b = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    on = (F.col("a.entity") == F.col("b.entity")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.name") < F.col("b.name"))
    return a.join(b, on).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
