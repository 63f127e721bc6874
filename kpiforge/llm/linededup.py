"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Lines (separated by \\n) are normalised (trimmed, lower case); lines without a character
other than blanks stay. Lines are duplicates when they are equal, or within as many edits
as the shorter one's length allows: none below ``SHORT`` code points, one below
``MIN_CHARS``, ``MAX_EDITS`` = 2 from there. Classes are the connected components. Of
each class the first line of the smallest doc_id stays and the others are removed.

Join: a line is split into as many segments as edits and one more, whose length follows
the line's length (in steps of ``CLASS``, so that up to CLASS - 1 code points and what
lies between middle and suffix belong to none); a line is also entered among those up to
two shorter. With one edit, the first or the last half is whole and in its place. With
two: edits that spare the part up to the prefix's end or from the middle's end leave
prefix or suffix in place; otherwise each of those parts has one edit, and the middle is
whole and shifted by at most one. So the index holds three substrings of each distinct
line, and five are probed. Texts are fetched for the lines that share an index entry; in
the join of these the counts of the letters a to z may differ by twice the edits in sum
at most. Candidates are verified by banded bit-parallel edit distance (one word of 2t + 1
bits slides along the diagonal, one step for each character).

A substring that more than ``HOT_KEY`` lines share (a common opening) is not joined as it
is: what remains of the lines must itself be within the edits, so the remainder is split
again and the pair must share a segment of it too, up to ``LEVELS`` times.

Equality is by 64-bit hash of the line. Exact copies are merged before the join, so a
line in a third of all documents is one entry of the index.

Defined results: a null or empty text has no lines to remove (a null text stays null);
lines of any length are compared whole; rows with one doc_id count as one document, so
none of their lines goes in favour of another row's; a null doc_id ranks last, and rows
without an id are documents of their own unless their texts are equal; an empty table
gives no rows; extra columns are passed over, whatever their names (``deduplicated``
returns them unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, connected_components, stage, with_text

MAX_EDITS = 2
MIN_CHARS = 24  # from here two edits make no other line
SHORT = 12  # from here one edit makes none
CLASS = 6  # width of a length class
HOT_KEY = 256  # lines that share a substring above which what remains of them is split again
LEVELS = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
NO_DOC = 2**63 - 1


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def letter_counts(line: Column) -> list[Column]:
    """Two longs with the counts of a to z, 4 bits each (modulo 16), 13 letters a long."""
    counts = [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long") for c in LETTERS]
    packed = []
    for own in (counts[:13], counts[13:]):
        total = F.lit(0).cast("long")
        for k, n in enumerate(own):
            total = total.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15).cast("long")), 4 * k))
        packed.append(total)
    return packed


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of 13 packed counts, never more than the true sum."""
    total = F.lit(0).cast("long")
    mask = F.lit(15).cast("long")
    for k in range(13):
        d = (F.shiftright(a, 4 * k).bitwiseAND(mask) - F.shiftright(b, 4 * k).bitwiseAND(mask)).bitwiseAND(mask)
        total = total + F.least(d, 16 - d)
    return total


def class_of(n: Column, least: int) -> Column:
    """The least length of the class of length ``n``, none below ``least``."""
    n = F.greatest(n, F.lit(least))
    return (n - n % CLASS).cast("int")


def _part(salt: Column | int, which: int, low: Column, line: Column, begin: Column, size: Column) -> Column:
    return F.xxhash64(salt if isinstance(salt, Column) else F.lit(salt), F.lit(which), low, F.substring(line, begin, size))


def _thirds(salt: Column | int, line: Column, n: Column, low: Column) -> Column:
    """Keys for two edits: prefix, middle, suffix, middle one to the left, one to the right (the last two probe only)."""
    third = F.floor(low / 3).cast("int")
    return F.array(_part(salt, 1, low, line, F.lit(1), third), _part(salt, 2, low, line, third + 1, third),
                   _part(salt, 3, low, line, n - third + 1, third), _part(salt, 2, low, line, third, third),
                   _part(salt, 2, low, line, third + 2, third))


def _halves(line: Column, n: Column, low: Column) -> Column:
    """Keys for one edit: first and last half, at the places of prefix and suffix."""
    half = F.floor(low / 2).cast("int")
    none = F.lit(None).cast("long")
    return F.array(_part(0, 4, low, line, F.lit(1), half), none, _part(0, 5, low, line, n - half + 1, half), none, none)


def _keys(line: Column, n: Column, low: Column) -> Column:
    """Keys of a line in the length class that begins at ``low``."""
    return F.when(low >= MIN_CHARS, _thirds(0, line, n, low)).otherwise(_halves(line, n, low))


def line_table(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """One row per line with a character: document, position, hash, length, keys. max_edits is 0, 1 or 2."""
    if not 0 <= max_edits <= 2:  # three segments, shifts of one at most
        raise ValueError("max_edits must be 0, 1 or 2")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.xxhash64(text).alias("hash"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(
        "doc", "hash", "pos", normal(F.col("raw")).alias("line"))
    lines = lines.withColumn("n", F.length("line")).where(F.col("n") > 0)
    low, lower = class_of(F.col("n"), SHORT), class_of(F.col("n") - max_edits, SHORT)
    joined = F.col("n") >= SHORT
    return lines.select("doc", "hash", "pos", "n", F.xxhash64("line").alias("lid"),
                        F.when(joined, _keys(F.col("line"), F.col("n"), low)).alias("keys"),
                        F.when(joined & (lower < low), _keys(F.col("line"), F.col("n"), lower)).alias("lower_keys"))


def _document(doc: Column, text_hash: Column) -> Column:
    """What tells documents apart: the id, and the text where there is no id."""
    return F.struct(doc.alias("doc"), F.when(doc == NO_DOC, text_hash).otherwise(F.lit(0).cast("long")).alias("alt"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per distinct line: smallest document, occurrences, length, keys (one column each)."""
    keys = [F.min(F.get(c, F.lit(k))).alias(f"{c[0]}{k}") for c in ("keys", "lower_keys") for k in range(5)]
    return lines.groupBy("lid").agg(F.min(_document(F.col("doc"), F.col("hash"))).alias("first"),
                                    F.count("*").alias("times"), F.min("n").alias("n"), *keys)


def shared_keys(distinct: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(key, lid, kind, low): the entries of keys that an index entry and another line share.

    kind is the place in ``_thirds``; the kinds above 2 probe only.
    """
    low = {"k": class_of(F.col("n"), SHORT), "l": class_of(F.col("n") - max_edits, SHORT)}
    keys = F.array(*[F.struct(F.col(f"{c}{k}").alias("key"), F.lit(k).alias("kind"), low[c].alias("low"))
                     for c in "kl" for k in range(5)])
    entries = distinct.select("lid", F.explode(keys).alias("e")).select("e.key", "lid", "e.kind", "e.low").where(
        "key is not null")
    shared = entries.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.min("kind").alias("kind"))
    shared = stage(shared.where("lo < hi and kind < 3").select("key"), "line-keys")
    return entries.join(broadcast_if_small(shared), "key")


def _split_again(rows: DataFrame, level: int) -> DataFrame:
    """Entries of a hot key, each as those of what remains of its line: key, probe, rest.

    ``rest`` of a row is what must be within the edits for lines that share its key (two
    parts around a middle, one edit each). Its keys are salted with the hot key.
    """
    key, rest = F.col("key"), F.col("rest")
    m = F.length(rest)
    low, lower = class_of(m, CLASS), class_of(m - MAX_EDITS, CLASS)

    def entries(at: Column) -> Column:
        third = F.floor(at / 3).cast("int")
        more = at - third >= CLASS  # all that share the key have that much left
        none = F.lit(None).cast("string")
        left = [F.when(more, F.substring(rest, third + 1, m)), none,
                F.when(more, F.substring(rest, F.lit(1), m - third)), none, none]
        found = _thirds(key, rest, m, at)
        return F.array(*[F.struct(F.get(found, F.lit(k)).alias("key"), F.lit((1 << level) if k > 2 else 0).alias("bit"),
                                  left[k].alias("rest")) for k in range(5)])

    none = F.expr("cast(array() as array<struct<key:bigint,bit:int,rest:string>>)")
    whole = F.concat(entries(low), F.when(lower < low, entries(lower)).otherwise(none))
    size = F.floor((F.floor(F.col("low") / 3) - 1) / 2).cast("int")

    def ends(part: Column) -> Column:
        return F.array(F.concat(F.lit("<"), F.substring(part, F.lit(1), size)),
                       F.concat(F.lit(">"), F.substring(part, F.length(part) - size + 1, size)))

    around = F.flatten(F.transform(ends(F.col("before")), lambda x: F.transform(ends(F.col("after")), lambda y: F.struct(
        F.xxhash64(key, x, y).alias("key"), F.lit(0).alias("bit"), F.lit(None).cast("string").alias("rest")))))
    again = rows.select("lid", "probe", "c1", "c2", "low", F.explode(
        F.when(rest.isNotNull(), whole).otherwise(around)).alias("e"))
    return again.select(F.col("e.key").alias("key"), "lid", F.col("probe").bitwiseOR(F.col("e.bit")).alias("probe"),
                        F.col("e.rest").alias("rest"), F.lit(None).cast("string").alias("before"),
                        F.lit(None).cast("string").alias("after"), "low", "c1", "c2")


def _remainders(members: DataFrame, texts: DataFrame) -> DataFrame:
    """What remains of each line beside the substring of its entry."""
    line, n, kind = F.col("line"), F.length("line"), F.col("kind")
    two = F.col("low") >= MIN_CHARS
    size = F.when(two, F.floor(F.col("low") / 3)).otherwise(F.floor(F.col("low") / 2)).cast("int")
    begin = F.when(kind == 3, size).when(kind == 4, size + 2).otherwise(size + 1)
    middle = two & kind.isin(1, 3, 4)
    return members.join(texts, "lid").select(
        "key", "lid", "probe", "low", "c1", "c2",
        F.when(kind == 0, F.substring(line, size + 1, n)).when(kind == 2, F.substring(line, F.lit(1), n - size)).alias("rest"),
        F.when(middle, F.substring(line, F.lit(1), begin - 1)).alias("before"),
        F.when(middle, F.substring(line, begin + size, n)).alias("after"))


def _joined(rows: DataFrame, max_edits: int) -> DataFrame:
    """(a, b) of lines under one key, one of them as an index entry at every level, with near letter counts."""
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("lid", "probe", "c1", "c2")]) for side in "ab")
    apart = counts_apart(F.col("c1_a"), F.col("c1_b")) + counts_apart(F.col("c2_a"), F.col("c2_b"))
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("lid_a") < F.col("lid_b"))
                              & (F.col("probe_a").bitwiseAND(F.col("probe_b")) == 0) & (apart <= 2 * max_edits))
    return pairs.select(F.col("lid_a").alias("a"), F.col("lid_b").alias("b"))


def candidates(members: DataFrame, texts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b), a < b: lines that share a key and have near letter counts; ``texts`` has (lid, line)."""
    first, second = letter_counts(F.col("line"))
    probe = F.when(F.col("kind") > 2, 1).otherwise(0).alias("probe")
    rows = stage(members.join(texts.select("lid", first.alias("c1"), second.alias("c2")), "lid").select(
        "key", "lid", "kind", "low", probe, "c1", "c2"), "line-members")
    found = []
    for level in range(1, LEVELS + 1):
        held = rows.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > HOT_KEY)
        hot = stage(held.select("key"), "line-hot")
        if hot.isEmpty():
            break
        few = broadcast_if_small(hot)
        found.append(_joined(rows.join(few, "key", "left_anti"), max_edits))
        rows = rows.join(few, "key", "left_semi")
        if level == 1:
            rows = _remainders(rows, texts)
        closed = rows.where("rest is null and before is null")
        if level > 1:
            found.append(_joined(closed, max_edits))
        rows = stage(_split_again(rows.where("rest is not null or before is not null"), level), "line-members")
    found.append(_joined(rows, max_edits))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def within_edits(xs: Column, ys: Column, m: Column, n: Column, max_edits: int = MAX_EDITS) -> Column:
    """Whether the edit distance of two strings longer than ``max_edits`` is at most that.

    xs and ys are their characters, m and n their lengths (columns of a row, so
    that nothing is computed again at every step). Banded bit-parallel: bit k of a word of 2t + 1 bits stands for row
    i + k - t of column i. vp and vn hold the vertical steps up and down; the
    distance is followed along the lowest diagonal of the band to the last
    row, and then along that row.
    """
    t, top = max_edits, 2 * max_edits
    full = (1 << (top + 1)) - 1

    def no(bits: Column) -> Column:
        return F.bitwise_not(bits).bitwiseAND(F.lit(full))

    def bit(word: Column, k: Column) -> Column:
        return F.expr("1").bitwiseAND(F.call_function("shiftright", word, k))

    def step(state: Column, i: Column) -> Column:
        match = F.lit(0)
        for k in range(top + 1):
            same = F.coalesce(F.get(xs, i + (k - t)) == F.get(ys, i), F.lit(False))
            match = match.bitwiseOR(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)))
        vp, vn = state.vp, state.vn

        def diagonal(eq: Column) -> Column:
            carry = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)
            return carry.bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def advance(d0: Column) -> Column:
            hp = vn.bitwiseOR(no(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            moved = F.shiftright(d0, 1)
            row = F.lit(top - 1) - (i - (m - t))
            change = F.when(i < m - t, 1 - F.shiftright(d0, top)).otherwise(bit(hp, row) - bit(hn, row))
            return F.struct(hn.bitwiseOR(no(moved.bitwiseOR(hp))).alias("vp"), moved.bitwiseAND(hp).alias("vn"),
                            (state.d + change).alias("d"))

        bound = F.transform(F.array(match), diagonal)  # names the value once
        return F.get(F.transform(bound, advance), F.lit(0))

    start = F.struct(F.lit(((1 << (t + 1)) - 1) << t).alias("vp"), F.lit(0).alias("vn"), F.lit(t).alias("d"))
    walked = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s.d)
    return (F.abs(m - n) <= t) & (walked <= t)


def verified(pairs: DataFrame, texts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """The pairs within ``max_edits`` edits; ``texts`` has (lid, line)."""
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    # Written, so that the filter below is not pushed under the splitting and repeats it at every step.
    both = stage(both.select("a", "b", F.split("x", "").alias("xs"), F.split("y", "").alias("ys"),
                             F.length("x").alias("m"), F.length("y").alias("n")), "line-chars")
    def within(edits: int) -> Column:
        return within_edits(F.col("xs"), F.col("ys"), F.col("m"), F.col("n"), min(edits, max_edits))

    shorter = F.least("m", "n")
    near = F.when(shorter >= MIN_CHARS, within(2)).when(shorter >= SHORT, within(1)).otherwise(F.lit(False))
    return both.where(near).select("a", "b")


def texts_of(docs: DataFrame, distinct: DataFrame, lids: DataFrame) -> DataFrame:
    """(lid, line) of the lines with these hashes, read from the first document that has each."""
    wanted = stage(distinct.select("lid", "first").join(lids, "lid"), "lines-wanted")
    sources = stage(wanted.select("first.doc", "first.alt").distinct(), "lines-sources")
    own = _document(F.coalesce("doc_id", F.lit(NO_DOC)), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(own.alias("own"), "text").select("own.doc", "own.alt", "text").join(
        broadcast_if_small(sources), ["doc", "alt"], "left_semi")
    lines = rows.select(F.explode(F.split("text", "\n")).alias("raw")).select(normal(F.col("raw")).alias("line"))
    lines = lines.select(F.xxhash64("line").alias("lid"), "line").join(
        broadcast_if_small(wanted.select("lid")), "lid", "left_semi")
    return lines.groupBy("lid").agg(F.min("line").alias("line"))


def removals(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc, hash, drop): positions of the lines to remove, per document that has any."""
    lines = stage(line_table(docs, max_edits), "lines")
    distinct = stage(distinct_lines(lines), "lines-distinct")
    members = stage(shared_keys(distinct, max_edits), "line-entries")
    texts = stage(texts_of(docs, distinct, members.select("lid").distinct()), "line-texts")
    pairs = stage(candidates(members, texts, max_edits), "line-pairs")
    classes = connected_components(verified(pairs, texts, max_edits), "line-links").select(
        F.col("node").alias("lid"), "component")
    known = distinct.select("lid", "first", "times").join(classes, "lid", "left").where(
        "component is not null or times > 1").select(
        "lid", "first", F.coalesce("component", "lid").alias("class"))
    owner = known.groupBy("class").agg(F.min("first").alias("owner"))
    member = stage(known.join(owner, "class").select("lid", "class", "owner"), "line-classes")
    own = _document(F.col("doc"), F.col("hash")) == F.col("owner")
    hits = lines.select("doc", "hash", "pos", "lid").join(member, "lid").select(
        "doc", "hash", F.struct("class", "pos", own.alias("own")).alias("e"))
    found = hits.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("e")).alias("es"))
    es = F.col("es")
    gone = F.filter(es, lambda e, i: ~e.own | F.coalesce(F.get(es, i - 1)["class"] == e["class"], F.lit(False)))
    return found.select("doc", "hash", F.sort_array(F.transform(gone, lambda e: e.pos)).alias("drop")).where(
        F.size("drop") > 0)


def summary(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per row the removed line positions (from 0, comma-joined)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)).alias("ld_doc"), F.xxhash64(text).alias("ld_hash"),
                       (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    drops = removals(docs, max_edits).select(F.col("doc").alias("ld_doc"), F.col("hash").alias("ld_hash"), "drop")
    return rows.join(drops, ["ld_doc", "ld_hash"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("drop", ","), F.lit("")).alias("removed"))


def deduplicated(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """The documents, all columns, without the removed lines (n_chars follows the text)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"))
    rows = rows.join(removals(docs, max_edits), ["doc", "hash"], "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("drop", i)), "\n")
    return with_text(rows, docs.columns, F.when(F.col("drop").isNull(), text).otherwise(kept))
