"""Canonical exact fingerprints, in built-in functions only.

A text is folded (Unicode composition, case, white space) and hashed to 128 bits. Rows are grouped by hash; inside a hash
that several rows have, the folded texts themselves are compared, and different texts get different suffixes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, join_groups, sendable

#: White space: code points below U+0100 one by one, which the matcher looks up in a bit set, and the others.
NARROW, BROAD = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0", r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Latin letters, signs and general punctuation up to here can't change under composition or folding, but for those of `odd`.
LATIN, PUNCTUATION = 0x2FF, (0x2010, 0x2027)


def _class(chars: list[str]) -> str:
    """A regular expression class of characters in ascending order."""
    out, k = [], 0
    while k < len(chars):
        end = k
        while end + 1 < len(chars) and ord(chars[end + 1]) == ord(chars[end]) + 1:
            end += 1
        out.append(f"\\x{{{ord(chars[k]):X}}}" + (f"-\\x{{{ord(chars[end]):X}}}" if end > k else ""))
        k = end + 1
    return "[" + "".join(out) + "]"


class Tables:
    """What canonical composition and case folding do, from the Unicode tables at hand. Hangul has rules of its own."""

    def __init__(self):
        chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
        nfd, nfc = (lambda c: unicodedata.normalize("NFD", c)), (lambda c: unicodedata.normalize("NFC", c))
        self.marks = [c for c in chars if unicodedata.combining(c)]
        self.apart = [(c, nfd(c)) for c in chars if nfd(c) != c]
        pairs = []
        for c, whole in self.apart:
            if nfc(c) == c:
                a, b = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
                pairs.append((len(whole), nfc(a) + b, c))
        pairs = [(ab, c) for _, ab, c in sorted(pairs)]
        self.pairs = [(ab, c) for ab, c in pairs if unicodedata.combining(ab[-1])]
        # Pairs whose second character is no mark, and marks that such a pair may take afterwards.
        self.letters = [(ab, c) for ab, c in pairs if not unicodedata.combining(ab[-1])]
        made = {c for _, c in self.letters}
        self.letters += [(ab, c) for ab, c in pairs if ab[0] in made and unicodedata.combining(ab[-1])]
        seconds = sorted({ab[-1] for ab, _ in pairs})
        #: Texts with none of these are composed: characters that join the one before, that stand for others, two marks in a row.
        unstable = sorted({*seconds, *(c for c, _ in self.apart if nfc(c) != c), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))})
        plain = [chr(c) for c in (*range(LATIN + 1), *range(PUNCTUATION[0], PUNCTUATION[1] + 1))]
        assert not set(plain) & {*unstable, *self.marks}
        #: Most texts have none of these, a class of few ranges; only the others are looked at with the classes of many ranges.
        self.maybe_unstable = f"[^{_class(plain)[1:]}"
        self.any_mark = _class(self.marks)
        self.unstable = f"{_class(unstable)}|{self.any_mark}{{2}}"
        odd = [c for c in chars if c != "ß" and c.casefold() != (c.lower() if c not in "Σ\u0130" else "")]
        self.odd = _class(odd)
        self.maybe_odd = f"[^{_class([c for c in plain if c not in set(odd)])[1:]}"
        self.folds = [(c, c.casefold()) for c in odd]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


#: Jamo: leading consonants, vowels, trailing consonants; a syllable of the first two, and what may follow to join it.
LEADING, VOWELS, TRAILING = r"[\x{1100}-\x{1112}]", r"[\x{1161}-\x{1175}]", r"[\x{11A8}-\x{11C2}]"
JOINING = rf"{LEADING}{VOWELS}|[\x{{AC00}}-\x{{D7A3}}]{TRAILING}"


def hangul(text: Column) -> Column:
    """Jamo become syllables. The text is cut before each place where some join; each part has them at its start."""

    def joined(part: Column) -> Column:
        a, b, c = (F.ascii(F.substring(part, i, 1)) for i in (1, 2, 3))  # code points
        tail = lambda x: F.when(x.between(0x11A8, 0x11C2), x - 0x11A7).otherwise(0)
        two = a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
        one = a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
        code = F.when(two, F.lit(0xAC00) + ((a - 0x1100) * 21 + b - 0x1161) * 28 + tail(c)).otherwise(a + tail(b))
        used = F.when(two & (tail(c) > 0), 3).otherwise(2)
        made = F.concat(F.decode(F.unhex(F.hex(code)), "UTF-16BE"), part.substr(used + 1, F.length(part)))
        return F.when(two | one, made).otherwise(part)

    return F.when(text.rlike(JOINING), F.array_join(F.transform(F.split(text, f"(?={JOINING})"), joined), "")).otherwise(text)


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.map_from_arrays(F.split(F.lit(",".join(a for a, _ in pairs)), ","), F.split(F.lit(",".join(b for _, b in pairs)), ","))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def cluster_composed(cluster: Column) -> Column:
    """Canonical composition of a character and the marks that follow it: taken apart, marks in the order of their classes, and
    put together again one mark after another. A mark of the same or a higher class in between keeps a mark apart."""
    t = tables()
    apart, pairs = _map(t.apart), _map(t.pairs)
    marks, ranks = "".join(t.marks), "".join(chr(unicodedata.combining(c)) for c in t.marks)
    rank = lambda c: F.when(c.rlike(t.any_mark), F.ascii(F.translate(c, marks, ranks))).otherwise(0)
    whole = F.array_join(F.transform(_characters(cluster), lambda c: F.coalesce(F.try_element_at(apart, c), c)), "")
    ordered = F.array_sort(F.transform(_characters(whole), lambda c, i: F.struct(rank(c).alias("rank"), i.alias("i"), c.alias("c"))))
    state = lambda base, rest, last: F.struct(base.alias("base"), rest.alias("rest"), last.alias("last"))

    def add(s: Column, x: Column) -> Column:
        made = F.try_element_at(pairs, F.concat(s["base"], x["c"]))
        joins = made.isNotNull() & (s["last"] < x["rank"])
        return F.when(joins, state(made, s["rest"], s["last"])).when(x["rank"] == 0, state(F.concat(s["base"], x["c"]), s["rest"], s["last"])).otherwise(state(s["base"], F.concat(s["rest"], x["c"]), x["rank"]))

    return F.aggregate(ordered, state(F.lit(""), F.lit(""), F.lit(0)), add, lambda s: F.concat(s["base"], s["rest"]))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def composed(text: Column) -> Column:
    """Canonical composition. Texts in which nothing can change pass."""
    t = tables()
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[^{t.any_mark[1:]}{t.any_mark}*|{t.any_mark}+"), F.lit(0))
    slow = F.array_join(F.transform(clusters, lambda c: F.when(c.rlike(t.unstable), cluster_composed(c)).otherwise(c)), "")
    letters = F.split(F.lit(",".join(c + ab for ab, c in t.letters)), ",")
    slow = F.aggregate(letters, slow, lambda s, p: F.replace(s, F.substring(p, 2, 9), F.left(p, F.lit(1))))
    return F.when(is_ascii(text), text).when(text.rlike(t.maybe_unstable) & text.rlike(t.unstable), hangul(slow)).otherwise(text)


def case_folded(text: Column) -> Column:
    """Full case folding: what lower case does not do, by a table, then lower case. (Cherokee thus becomes small letters.)"""
    t = tables()
    single = [(a, b) for a, b in t.folds if len(b) == 1]
    several = F.split(F.lit(",".join(a + b for a, b in t.folds if len(b) > 1)), ",")
    odd = F.aggregate(several, F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single)), lambda s, p: F.replace(s, F.left(p, F.lit(1)), F.substring(p, 2, 9)))
    sharp = lambda c: F.replace(c, F.lit("ß"), F.lit("ss"))
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.lower(sharp(F.when(text.rlike(t.maybe_odd) & text.rlike(t.odd), odd).otherwise(text))))


def spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces are not touched."""
    narrow = F.when(~is_ascii(text) & text.rlike(f"[{BROAD}]"), F.regexp_replace(text, f"[{BROAD}]", " ")).otherwise(text)
    return F.trim(F.regexp_replace(narrow, f"[{NARROW}]{{2,}}|[{NARROW[1:]}]", " "))


def with_canonical(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds out: the text composed, case-folded, with runs of white space as one space and none at the ends. Each step is a
    projection of its own, so that none is evaluated again by the next."""
    df = df.withColumn(out, composed(F.col(text_col)))
    df = df.withColumn(out, case_folded(F.col(out)))
    return df.withColumn(out, spaced(F.col(out)))


def wide(text: Column) -> Column:
    """128 bits: two hashes of the folded text, the second begun with another value."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("second"), text))), 16, "0"))


def successors(docs: DataFrame, id_col: str, steps: Steps) -> DataFrame:
    """id, n_chars, and the next smaller id with its length, around the end: the largest id precedes the smallest.

    Ids are sorted by ranges; only the first and last of each range meet in one task.
    """
    ids = docs.groupBy(id_col).agg(F.max("n_chars").alias("n_chars")).select(F.col(id_col).alias("id"), "n_chars")
    ids = steps.write(ids.repartitionByRange(F.col("id")).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range").orderBy("id")
    ids = ids.withColumn("_prev", F.lag(F.struct("id", "n_chars")).over(own))
    ends = ids.groupBy("_range").agg(F.max(F.struct("id", "n_chars")).alias("_last"))
    # One row for each range: no more than there are shuffle partitions.
    ends = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_range"))).withColumn("_end", F.max(F.struct("_range", "_last")).over(Window.partitionBy()))
    ends = ends.select("_range", F.coalesce("_before", "_end._last").alias("_before"))
    out = ids.join(F.broadcast(ends), "_range").withColumn("_prev", F.coalesce("_prev", "_before"))
    return out.select("id", F.col("_prev.id").alias("prev_id"), F.col("_prev.n_chars").alias("prev_chars"))


def named(hash_col: str, suffix_col: str) -> Column:
    return F.concat(F.col(hash_col), F.when(F.col(suffix_col) > 0, F.concat(F.lit("-"), F.col(suffix_col).cast("string"))).otherwise(F.lit("")))


def suffixes(compared: DataFrame, steps: Steps) -> DataFrame | None:
    """(id, row, kind, suffix > 0) for rows (id, row, kind, hash, canon) whose hash belongs to more than one folded text; None if
    there are none.

    Each task reduces each hash to its smallest and largest text, and these are reduced again; that they are equal shows that
    all are. Only where they differ, the rows of a hash are shuffled.
    """
    ends = compared.groupBy("hash").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    ends = steps.write(ends.filter(F.col("least") != F.col("most")).select("hash"), "differ")
    if not ends.limit(1).count():
        return None
    differ = compared.join(ends, "hash")
    order = Window.partitionBy("hash").orderBy("canon")
    ranks = differ.select("hash", "canon").distinct().withColumn("suffix", F.row_number().over(order) - 1)
    return differ.join(ranks, ["hash", "canon"]).filter("suffix > 0").select("id", "row", "kind", "suffix").distinct()


def edited_text(text: Column, start: Column) -> Column:
    """The last quarter of text is replaced by as much of start."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(text.substr(F.lit(1), n - quarter), start.substr(F.lit(1), quarter))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter replaced by the start of the next document.

    One row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    likeness of two exact fingerprints is 1 where they are equal and 0 elsewhere. Null counts as empty. The next document has
    the next larger id, the first follows the last; where several rows have one id, the smallest of their texts is next. An
    empty table gives no rows. Other columns are ignored. Ids must not be null.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    steps = Steps(docs.sparkSession, "fingerprints")
    order = successors(texts.select("id", F.length("text").alias("n_chars")), "id", steps)
    # Each text is folded once; its hash goes with it, to its own row and to that of the document before it.
    by_id = with_canonical(texts, "text", "canon").select("id", "text", wide(F.col("canon")).alias("hash")).repartition("id")
    start = F.col("text").substr(F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int"))
    starts = by_id.join(order.hint("merge"), "id").select(F.col("prev_id").alias("id"), F.struct(start.alias("start"), F.xxhash64("text").alias("row"), F.col("id"), "hash").alias("next"))
    starts = starts.groupBy("id").agg(F.min("next").alias("next"))
    both = by_id.join(starts.hint("merge"), "id").withColumn("edited", edited_text(F.col("text"), F.col("next.start")))
    found = steps.write(
        with_canonical(both, "edited", "canon").select(
            "id", F.xxhash64("text").alias("row"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash",
            wide(F.col("canon")).alias("edited_hash"), F.col("next.hash").alias("next_hash"), F.col("next.id").alias("next_id"), F.col("next.row").alias("next_row")),
        "fingerprints")

    # Rows that share a hash with others, and the texts that they are made of.
    hashes = found.select("id", "row", "next_id", "next_row", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("hash")), F.struct(F.lit("e").alias("kind"), F.col("edited_hash").alias("hash")))).alias("h"))
    hashes = hashes.select("id", "row", "next_id", "next_row", "h.kind", "h.hash")
    many = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    shared = steps.write(join_groups(hashes, many, ["hash"], "n", 2 * found.count(), steps).drop("n"), "shared")
    need = shared.select("id").union(shared.filter("kind = 'e'").select(F.col("next_id").alias("id"))).distinct()
    small = texts.join(sendable(need), "id").withColumn("row", F.xxhash64("text")).distinct()
    small = steps.write(small, "texts")
    own = shared.filter("kind = 't'").join(small, ["id", "row"])
    nxt = small.select(F.col("id").alias("next_id"), F.col("row").alias("next_row"), F.col("text").alias("start"))
    edited = shared.filter("kind = 'e'").join(small, ["id", "row"]).join(nxt, ["next_id", "next_row"]).withColumn("text", edited_text(F.col("text"), F.col("start")))
    compared = own.select("id", "row", "kind", "hash", "text").unionByName(edited.select("id", "row", "kind", "hash", "text"))
    extra = suffixes(with_canonical(compared, "text", "canon").select("id", "row", "kind", "hash", "canon"), steps)
    if extra is None:
        found = found.select("*", *(F.lit(0).alias(c) for c in ("s", "es", "ns")))
    else:
        extra = steps.write(extra, "suffixes")
        for kind, keys, name in (("t", ("id", "row"), "s"), ("e", ("id", "row"), "es"), ("t", ("next_id", "next_row"), "ns")):
            mine = extra.filter(F.col("kind") == kind).select(F.col("id").alias(keys[0]), F.col("row").alias(keys[1]), F.col("suffix").alias(name))
            found = found.join(mine, list(keys), "left")
    steps.drop("ranges", "shared", "texts", "groups", "differ")
    fp, ep, np_ = named("hash", "s"), named("edited_hash", "es"), named("next_hash", "ns")
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    return found.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fp.alias("fingerprint"), ep.alias("edited_fingerprint"), same(fp, ep).alias("near_edited"), same(fp, np_).alias("near_next"))
