"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines within `threshold` edits of each other are duplicates; the threshold is one number or grows with
the length of the shorter line. A line is cut into threshold + 1 segments of which a duplicate must
contain one unchanged, near its place from the left or the right end: the index has the segments of
each line by its length, and a line probes the indexes of its own and of the shorter lengths with
those of its substrings that can match when errors between the end and the segment are counted
(multi-match-aware selection).

Only the classes of duplicates matter, so candidates are never written out pair by pair. The lines
that share an index key form a group, and groups of equal members are one. Groups meet in cells of
bounded size, each of them one row that holds its lines. At first every line looks for one duplicate
in one block of its group, twice with other blocks; what that links becomes classes. Then all cells
with lines of different classes are looked at whole, and each line gives one duplicate of every other
class that has one. Whatever is linked is verified by a banded automaton of bit-parallel steps. Of
each class the first occurrence stays, in order of doc_id and place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, blank, components, pick, stage, table, unstage

#: Edits that duplicates may differ by, as (characters of the shorter line from which they hold, edits).
BANDS = ((0, 1), (40, 2))
#: Words, or characters in languages without blanks, that a line needs to be compared but for exact copies.
LEAST_WORDS, LEAST_CHARS = 5, 20
#: Letters whose counts tell lines apart before anything else is compared; others aren't looked at.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz 0123456789" + "\u043e\u0435\u0430\u0438\u043d\u0442\u0441\u0440\u0432\u043b\u03b1\u03bf\u03b9\u03b5"
#: Characters of the windows that are compared before whole lines.
WINDOW = 40
#: Lines, and characters of all lines, of one kind in a cell; two lines are always allowed.
CELL_ROWS, CELL_CHARS = 256, 4_000_000


def _words(least_words: int) -> Column:
    return F.regexp_like("line", F.lit(r"^\s*(?:\S+\s+){%d}\S" % (least_words - 1)))


def _lines(documents: DataFrame, least_words: int) -> DataFrame:
    """first (isnull, doc_id, row, pos), line, h1, h2, len of every line long enough. row tells rows of one doc_id apart."""
    # An outer explode, as Spark puts a filter that splits the text once more before another.
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    return rows.where(F.col("line").isNotNull() & _words(least_words)).select(first.alias("first"), "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.char_length("line").alias("len"))


Bands = tuple[tuple[int, int], ...]


def _bands(threshold: int | Bands) -> Bands:
    found = ((0, threshold),) if isinstance(threshold, int) else tuple(threshold)
    if found[0][0] != 0 or list(found) != sorted(found) or [e for _, e in found] != sorted(e for _, e in found):
        raise ValueError("bands start at 0 characters, and neither characters nor edits may fall")
    return found


def _within_band(bands: Bands, k: int, length: Column) -> Column:
    """Whether band k holds for this length."""
    above = length >= bands[k][0]
    return above & (length < bands[k + 1][0]) if k + 1 < len(bands) else above


def _index(lines: DataFrame, bands: Bands) -> DataFrame:
    """key, id (h1), len and own of every line's segments (own: 1) and probes (own: 0).

    Of two lines within t edits the shorter is the indexed one. Its segments have one size for all
    lengths of a bucket, are counted from the left end up to t // 2 and from the right end the others;
    either the left ones have t // 2 errors at most, or the right ones less than t - t // 2. So the
    i-th segment from one end stands unchanged in the longer line, i places off at most from that end.
    A line's own segments are among its probes of its own bucket.
    """
    size = F.col("len")

    def bucket(k: int, length: Column) -> Column:
        """The smallest length of the bucket; the longer line's probes meet two at most from 16 characters on."""
        start, threshold = bands[k]
        wide = max(start, 16)
        return F.when(length < wide, length).otherwise(wide + F.floor((length - wide) / (8 * threshold)) * (8 * threshold)).cast("int")

    met, places = [], {}
    for k, (_, threshold) in enumerate(bands):
        for delta in range(threshold + 1) if threshold else ():
            # The band and the bucket are those of the indexed line, delta characters shorter.
            length = size - delta
            new = _within_band(bands, k, length)
            if delta:
                new &= (bucket(k, length) != bucket(k, length + 1)) | ~_within_band(bands, k, length + 1)
            met.append(F.when(new, F.struct(F.lit(threshold).alias("edits"), bucket(k, length).alias("least"), F.lit(delta == 0).alias("home"))))
        # (left, i, shift): the i-th segment from one end, so many places off.
        ends = ((True, threshold // 2), (False, threshold - 1 - threshold // 2))
        places[threshold] = [(left, i, shift) for left, errors in ends for i in range(errors + 1) for shift in range(-i, i + 1)]
    if not met:
        return lines.select(F.lit(0).cast("long").alias("key"), F.col("h1").alias("id"), "len", F.lit(0).alias("own")).where("false")
    kind = "array<struct<left:boolean,i:int,shift:int>>"
    spots = F.lit(None).cast(kind)
    for threshold, found in places.items():
        spots = F.when(F.col("m.edits") == threshold, F.array(*(F.struct(*(F.lit(x) for x in p)) for p in found)).cast(kind)).otherwise(spots)
    rows = lines.select("h1", "line", "len", F.explode(F.array(*met)).alias("m")).where("m is not null")
    rows = rows.select("h1", "line", "len", "m", F.floor(F.col("m.least") / (F.col("m.edits") + 1)).cast("int").alias("q"), F.explode(spots).alias("p"))
    start = F.when(F.col("p.left"), F.col("q") * F.col("p.i")).otherwise(size - F.col("q") * (F.col("p.i") + 1)) + F.col("p.shift")
    rows = rows.withColumn("start", start).where("start >= 0 and start + q <= len")
    key = F.xxhash64("m.least", "m.edits", "p.i", "p.left", F.substring("line", F.col("start") + 1, F.col("q")))
    return rows.select(key.alias("key"), F.col("h1").alias("id"), "len", (F.col("m.home") & (F.col("p.shift") == 0)).cast("int").alias("own"))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether a and b differ by at most so many edits.

    For each number of errors a word of bits tells on which diagonals of the band the automaton can
    stand; one step takes one character of b on all diagonals at once.
    """
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    state = "struct<" + ",".join(f"e{d}:int" for d in range(threshold + 1)) + ">"

    def bits(x: Column, y: Column, j: Column) -> Column:
        c = F.get(y, j)
        return sum((F.when(F.get(x, j + (o - threshold)) == c, F.lit(1 << o)).otherwise(F.lit(0)) for o in range(1, width)), F.when(F.get(x, j - threshold) == c, F.lit(1)).otherwise(F.lit(0)))

    def start() -> Column:
        # Before any character of b, d errors reach the diagonals that skip up to d characters of a.
        return F.struct(*(F.lit(((1 << (d + 1)) - 1) << threshold).alias(f"e{d}") for d in range(threshold + 1))).cast(state)

    def move(s: Column, match: Column) -> Column:
        after = [s["e0"].bitwiseAND(match)]
        for d in range(1, threshold + 1):
            before = s[f"e{d - 1}"]
            taken = s[f"e{d}"].bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
            after.append(taken.bitwiseOR(F.shiftleft(after[d - 1], 1).bitwiseAND(F.lit(full))))
        return F.struct(*(e.alias(f"e{d}") for d, e in enumerate(after)))

    def run(x: Column, y: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda j: bits(x, y, j))
        end = F.aggregate(steps, start(), move)
        final = F.element_at(F.array(*(F.lit(1 << o) for o in range(width))), F.size(x) - F.size(y) + threshold + 1)
        return end[f"e{threshold}"].bitwiseAND(final) != 0

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    letters = lambda t: F.split(t, "")
    near = F.abs(F.char_length(a) - F.char_length(b)) <= threshold
    short = F.least(F.char_length(a), F.char_length(b)) == 0
    return near & (short | let(F.struct(letters(a).alias("x"), letters(b).alias("y")), lambda p: run(p["x"], p["y"])))


def _edits(bands: Bands, a: Column, b: Column, test: Callable[[int], Column]) -> Column:
    """test(threshold) by the band of the shorter line."""
    length, near = F.least(F.char_length(a), F.char_length(b)), F.lit(False)
    for k, (_, threshold) in enumerate(bands):
        near = F.when(_within_band(bands, k, length), test(threshold)).otherwise(near)
    return near


def _letters() -> Column:
    """For each of the LETTERS whether it stands an odd number of times in the line."""
    size = F.octet_length("line")
    bits = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        odd = (size - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))) / len(c.encode()) % 2
        bits += F.shiftleft(odd.cast("long"), k)
    return bits.alias("letters")


def _groups(lines: DataFrame, bands: Bands) -> DataFrame:
    """f1, f2 (the group), id, own, and of the group n lines, m of them indexed, and its longest line's size; staged."""
    index = stage(_index(lines, bands), "index")
    # Extremes are combined before the shuffle; a key with one line, which most have, ends here.
    shared = index.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("own")).where("low < high and own = 1")
    shared = stage(shared.select("key"), "keys")
    # A line may meet a key by several of its substrings, and stand in several places.
    rows = index.join(shared.hint("merge"), "key").groupBy("key", "id").agg(F.max("own").alias("own"), F.max("len").alias("len"))
    rows = stage(rows, "members")
    unstage(index)
    mark = lambda seed: F.bit_xor(F.xxhash64("id", "own", F.lit(seed)))
    whole = rows.groupBy("key").agg(mark(0).alias("f1"), mark(1).alias("f2"), F.count(F.lit(1)).alias("n"), F.sum("own").alias("m"), F.max("len").alias("size"))
    groups = stage(rows.join(whole, "key").select("f1", "f2", "id", "own", "n", "m", "size").distinct(), "groups")
    unstage(shared)
    unstage(rows)
    return groups


def line_classes(lines: DataFrame, bands: Bands) -> DataFrame:
    """id and component of all lines that are linked by lines within the threshold; staged.

    lines: h1, h2, len, line, repeated lines allowed. A line's id is (h1, h2, len).
    """
    groups = _groups(lines, bands)
    ids = stage(groups.select("id").distinct(), "ids")
    texts = among(lines, "h1", ids, "id").join(ids, F.col("h1") == F.col("id")).groupBy("h1", "h2", "len").agg(F.any_value("line").alias("line"))
    texts = stage(texts.select(F.col("h1").alias("id"), F.struct("h1", "h2", "len").alias("node"), "line", _letters()), "texts")
    unstage(ids)
    comps = None
    # Two looks at one block each, then one at all. A group of one cell that gave nothing at the first never will.
    for turn in range(3):
        part = groups.where(~_single()) if turn == 1 else groups
        now = part.join(texts, "id").withColumn("class", F.col("node"))
        if comps is not None:
            now = now.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        if turn:
            mixed = now.groupBy("f1", "f2").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
            now = now.join(mixed.select("f1", "f2"), ["f1", "f2"])
        found = stage(_cells(now, bands, turn), "found")
        if not found.isEmpty():
            pairs = found.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")) if turn == 2 else found
            pairs = pairs.select("p.*").distinct() if turn == 2 else pairs.select("a", "b").distinct()
            links = stage(_verified(pairs, texts, bands), "links")
            comps = components(links, known=comps)
            unstage(links)
        if turn == 0:
            before, groups = groups, stage(groups.where(~_single()).unionByName(groups.where(_single()).join(found.select("f1", "f2").distinct(), ["f1", "f2"], "left_semi")), "groups")
            unstage(before)
        unstage(found)
    unstage(groups)
    if comps is None:
        comps = components(texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    unstage(texts)
    return comps


def _single() -> Column:
    """Whether a group is one cell."""
    return (F.greatest("n", "m") <= CELL_ROWS) & (F.greatest("n", "m") * F.col("size") <= CELL_CHARS)


def _cells(rows: DataFrame, bands: Bands, turn: int) -> DataFrame:
    """f1, f2, a, b, ca, cb: pairs within the threshold of different classes ca and cb that meet in a cell.

    rows: f1, f2, own, n, m, size, node, class, line, letters. A cell has one block of indexed lines and
    one of all lines of a group. In the last turn every cell is looked at, and each line gives a pair for
    every class it has a duplicate in; before, each stands in one cell and gives one pair.
    """
    whole = turn == 2
    per = F.greatest(F.lit(2), F.least(F.lit(CELL_ROWS), F.floor(F.lit(CELL_CHARS) / F.greatest("size", F.lit(1))))).cast("long")
    spot = F.xxhash64("node", F.lit(turn))
    rows = rows.withColumn("wide", F.ceil(F.col("n") / per)).withColumn("high", F.ceil(F.col("m") / per))
    rows = rows.withColumn("i", F.pmod(spot, "high")).withColumn("j", F.pmod(F.shiftright(spot, 20), "wide"))
    # Windows at both ends and in the middle, by which most pairs are told apart.
    size = F.char_length("line")
    middle = F.substring(F.col("line"), F.floor((size - WINDOW) / 2).cast("int") + 1, F.lit(WINDOW))
    entry = F.struct("node", "class", "line", "letters", *(x.alias(n) for n, x in (("head", F.left("line", F.lit(WINDOW))), ("tail", F.right("line", F.lit(WINDOW))), ("middle", F.when(size > WINDOW, middle).otherwise("")))))
    if whole:
        mine, theirs = F.expr("sequence(0L, wide - 1)"), F.expr("sequence(0L, high - 1)")
    else:
        mine, theirs = F.expr("filter(sequence(0L, wide - 1), x -> x % high = i)"), F.expr("array(j % high)")
    rows = rows.withColumn("entry", entry)
    indexed = rows.where("own = 1").select("f1", "f2", "i", F.explode(mine).alias("j"), F.col("entry").alias("x"), F.lit(None).alias("y"))
    every = rows.select("f1", "f2", F.explode(theirs).alias("i"), "j", F.lit(None).alias("x"), F.col("entry").alias("y"))
    # A number of its own, as little data can be much work here.
    dealt = indexed.union(every).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f1", "f2", "i", "j")
    cells = dealt.groupBy("f1", "f2", "i", "j").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")).where((F.size("xs") > 0) & (F.size("ys") > 0))

    def near(a: Column, b: Column) -> Column:
        # An edit turns two letters' parities at most. Ends differ by twice the edits at most, as does what is
        # aligned with them; so does the middle, whose place may differ by half the edits, too. What Spark's
        # own bounded distance finds is decided by within() in the end.
        def test(t: int) -> Column:
            apart = lambda part, most: F.levenshtein(a[part], b[part], most) >= 0
            letters = F.bit_count(a["letters"].bitwiseXOR(b["letters"])) <= 2 * t
            return letters & apart("head", 2 * t) & apart("tail", 2 * t) & (apart("middle", 3 * t + 1) | (F.least(F.char_length(a["middle"]), F.char_length(b["middle"])) == 0)) & apart("line", t)

        return _edits(bands, a["line"], b["line"], test)

    def hits(a: Column) -> Column:
        """Places of the indexed lines that a is linked with."""
        known = lambda k, b: F.exists(k["at"], lambda p: F.get("xs", p)["class"] == b["class"])
        done = known if whole else lambda k, b: F.size(k["at"]) > 0
        step = lambda k, b: F.struct((k["next"] + 1).alias("next"), F.when((a["class"] == b["class"]) | done(k, b), k["at"]).when(near(a, b), F.concat(k["at"], F.array(k["next"]))).otherwise(k["at"]).alias("at"))
        return F.aggregate("xs", F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at")), step, lambda k: k["at"])

    met = cells.select("f1", "f2", "xs", F.explode_outer(F.transform("ys", lambda a: F.struct(a["node"].alias("a"), a["class"].alias("ca"), hits(a).alias("at")))).alias("p")).where(F.size("p.at") > 0)
    met = met.select("f1", "f2", "p.a", "p.ca", F.explode_outer(F.transform("p.at", lambda k: F.get("xs", k))).alias("x")).select("f1", "f2", "a", "ca", F.col("x.node").alias("b"), F.col("x.class").alias("cb"))
    turned = F.col("a") > F.col("b")
    pair = lambda x, y: (F.when(turned, F.col(y)).otherwise(F.col(x)), F.when(turned, F.col(x)).otherwise(F.col(y)))
    (a, b), (ca, cb) = pair("a", "b"), pair("ca", "cb")
    return met.select("f1", "f2", a.alias("a"), b.alias("b"), ca.alias("ca"), cb.alias("cb")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """Those of the pairs (a, b) within the threshold, decided by the banded automaton."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("t")), "b")
    return both.where(_edits(bands, F.col("s"), F.col("t"), lambda t: within(F.col("s"), F.col("t"), t))).select("a", "b")


def dedup_lines(documents: DataFrame, threshold: int | Bands = BANDS, least_words: int = LEAST_WORDS, short: bool = False) -> DataFrame:
    """The rows with their text freed of duplicate lines, and n_lines and n_removed.

    Lines end at line feeds; those of fewer than least_words words stay untouched unless short is set.
    Then only blank ones do: exact copies of all others go, and lines of LEAST_CHARS characters are
    compared whatever their words. The first of a
    class stays in the row of the smallest doc_id (nulls last), then by a hash of the row's text, then
    by place; rows equal in doc_id and text are one document and are treated alike. A null text stays
    null and has no lines. Columns n_lines and n_removed of the input are replaced, others are kept;
    an empty table gives no rows.
    """
    rows = pick(documents, "doc_id", "text")
    lines = stage(_lines(rows, 1 if short else least_words), "lines")
    name = ["h1", "h2", "len"]
    classes = line_classes(lines.where((F.col("len") >= LEAST_CHARS) | _words(least_words)), _bands(threshold))
    linked = classes.select("id.*", F.col("component").alias("class"))
    repeated = lines.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*name, F.struct(*name).alias("class"))
    repeated = repeated.join(linked.select(*name), name, "left_anti")
    # Lines that stand elsewhere too, or have duplicates. Joined by shuffle at every size, as these grow with the documents.
    known = stage(linked.union(repeated), "classes")
    places = stage(lines.join(known.hint("merge"), name).select("class", "first"), "places")
    for done in (lines, classes, known):
        unstage(done)
    # A table of its own, so that Spark can split a class with many places in the join.
    heads = stage(places.groupBy("class").agg(F.min("first").alias("head")), "heads")
    drop = places.join(heads, "class").where("first != head")
    drop = drop.groupBy(F.col("first.doc_id").alias("drop_id"), F.col("first.row").alias("drop_row")).agg(F.collect_set("first.pos").alias("drop_at"))
    # Positions for names, so that no column of the input can clash with the operator's.
    names = documents.columns
    place = {n: f"c{k}" for k, n in reversed(list(enumerate(names)))}
    named = documents.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("own", F.xxhash64(place["doc_id"], place["text"]))
    both = named.join(drop.hint("merge"), (F.col("own") == F.col("drop_row")) & F.col(place["doc_id"]).eqNullSafe(F.col("drop_id")), "left")
    parts = F.split(place["text"], "\n")
    kept = F.when(F.col("drop_at").isNull(), F.col(place["text"])).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("drop_at"), i)), "\n"))
    others = [k for k, n in enumerate(names) if n not in ("n_lines", "n_removed", "text")]
    out = both.select(*(f"c{k}" for k in others), kept.alias("kept"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("removed"))
    return out.toDF(*(names[k] for k in others), "text", "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents freed of lines that stand, but for a few edits (BANDS), in an earlier place."""
    done = dedup_lines(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), short=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(blank(F.col("text")), 256).alias("text_sha256"), "text")
