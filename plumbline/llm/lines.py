"""Line deduplication by a deletion-neighbourhood join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage
from plumbline.llm.common import sieve, sifted, written

BOUND = 1          # edits (insertion, deletion or change of one character) between lines that match; fixed by the variants
LEAST = 10         # characters of the shorter of two lines that match without being equal
WORDS = 6          # words of the shorter of two lines that match with one word apart
PIECE = 24         # characters (or words) of a piece, at least; longer lines have pieces of the root of their length
PLACE = 1 << 31    # lines of one document that places can tell apart
TIES = 1 << 26     # rows that share a doc_id with others, which numbers can tell apart (rows without one: any number)


def _lines(docs: DataFrame) -> DataFrame:
    """(place, h1, h2, line) of every line that is not blank; places order lines by document, then position."""
    number = F.col("__number") if "__number" in docs.columns else _by_id()
    rows = docs.select(number.alias("number"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(_visible(F.col("line")))
    wide = "decimal(28,0)" if "decimal" in dict(rows.dtypes)["number"] else "decimal(20,0)"    # 10 digits more for the position
    place = (F.col("number").cast(wide) * F.lit(PLACE).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    return rows.select(place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _by_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__number``, which orders rows by doc_id (null last) and which no two rows share.

    That is doc_id itself where all have one of their own.  Otherwise rows that lack one or share one are written in
    the order of doc_id and a hash of the text, dealt by ranges that also part equal texts, and each is counted; the count
    follows doc_id in the number.  Numbers per part come from one row per part.
    """
    ids = cut_lineage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 OR doc_id IS NULL").select("doc_id"))
    if ids.isEmpty():
        return docs.withColumn("__number", _by_id())
    several = ids.where("doc_id IS NOT NULL")
    odd = docs.where("doc_id IS NULL").union(docs.join(several, "doc_id", "left_semi").select(*docs.columns))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__hash"), F.col("__row")]
    odd = odd.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    odd = odd.repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__row")
    odd = written(odd.withColumn("__row", F.monotonically_increasing_id()), "lines-rows")
    part, at = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = odd.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))    # a row per part
    starts = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start")))
    tie = F.col("__start") + at
    tie = F.when(F.col("doc_id").isNull() | (tie < TIES), tie).otherwise(F.raise_error(F.lit("too many rows share a doc_id")).cast("long"))
    number = lambda tie: (_by_id().cast("decimal(19,0)") * F.lit(TIES).cast("decimal(8,0)") + tie.cast("decimal(19,0)")).cast("decimal(28,0)")
    odd = odd.withColumn("__part", part).join(starts, "__part").select(*docs.columns, number(tie).alias("__number"))
    even = docs.where("doc_id IS NOT NULL").join(several, "doc_id", "left_anti").select(*docs.columns, number(F.lit(0)).alias("__number"))
    return even.union(odd)


def _visible(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _symbols(docs: DataFrame, word: int) -> DataFrame:
    """``_lines`` with each line as what edits count: a string of characters, or with ``word`` an array of words."""
    rows = _lines(docs)
    return rows.withColumn("line", F.split("line", " ", -1)) if word else rows


def _ways(word: int):
    """How lines of characters, or of words, are cut, how long they are, and the least length that matches."""
    return (F.slice, F.size, WORDS) if word else (F.substring, F.length, LEAST)


def _halves(line: Column, word: int) -> list[Column]:
    """For both lengths that a line can be matched at, its own and one less: hash of the first half, and of the second."""
    part, length, enough = _ways(word)
    size = length(line)
    out = []
    for less in (0, 1):
        base = size - less
        front = F.floor(base / 2).cast("int")
        back = base - front
        for side, half in ((0, part(line, F.lit(1), front)), (1, part(line, size - back + 1, back))):
            out.append(F.when(base >= enough, F.xxhash64(F.lit(side), base, half)))
    return out


def _several(keys: DataFrame, key: str) -> DataFrame:
    """The keys that more than one line has."""
    return keys.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(key)


def _candidates(docs: DataFrame, shared: DataFrame, word: int) -> DataFrame:
    """Lines under each shared half: place, h1, h2, key, less, and what is left of the line without that half.

    The filter drops most lines before anything is shuffled; the join decides.
    """
    part, length, _ = _ways(word)
    rows, bits = _symbols(docs, word), sieve(shared)
    keys = [f"k{i}" for i in range(4)]
    rows = rows.withColumns(dict(zip(keys, _halves(F.col("line"), word))))
    for k in keys:
        rows = sifted(rows, k, bits, "hit").withColumn(k, F.when(F.col("hit"), F.col(k))).drop("hit")
    size = length("line")
    found = []
    for i, k in enumerate(keys):
        less, side = divmod(i, 2)
        front = F.floor((size - less) / 2).cast("int")
        rest = part("line", front + 1, size) if side == 0 else part("line", F.lit(1), front + less)
        found.append(F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("key"), F.lit(less).alias("less"), rest.alias("rest"))))
    rows = rows.select("place", "h1", "h2", F.explode(F.array_compact(F.array(*found))).alias("c")).select("place", "h1", "h2", "c.*")
    return rows.join(shared, "key")


def _pieces(found: DataFrame, word: int) -> DataFrame:
    """The rest of a line in pieces: the part that may differ, under a hash of all that must be equal around it."""
    part, length, _ = _ways(word)
    base = F.col("base")
    wide = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(base)).cast("int"))
    cut = found.withColumn("base", length("rest") - F.col("less")).withColumn("wide", wide) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(base / F.col("wide")).cast("int") - 1))))
    ahead = F.col("j") * F.col("wide")
    behind = F.greatest(F.lit(0), base - ahead - F.col("wide"))
    size = length("rest")
    return cut.select(
        "place", "h1", "h2", "less",
        F.xxhash64("key", "j", part("rest", F.lit(1), ahead), F.lit("\n"), part("rest", size - behind + 1, behind)).alias("piece"),
        part("rest", ahead + 1, size - ahead - behind).alias("middle"))


def near_lines(docs: DataFrame, word: int = 0) -> DataFrame:
    """(h1, h2) of lines for which an earlier line, different from it, is within the edit bound, or one word apart.

    Lines are one word apart when one word of up to ``word`` characters is changed to another such, added, or left out;
    the method is the same for both, with characters or words as symbols.
    """
    near = _near(docs, 0)
    return near.union(_near(docs, word)).distinct() if word else near


def _near(docs: DataFrame, word: int) -> DataFrame:
    """(h1, h2) of lines for which an earlier line is one symbol apart: a character, or a word of up to ``word`` of them.

    Method: the deletion neighbourhood of a line are the line and its variants with one character deleted.  Two lines
    of one length are one change apart if deleting at the same position makes them equal; a line is one insertion apart
    from another if it equals one of that line's variants.  Variants are hashed keys and meet in an equality join.

    A line of n characters has n variants of n characters, so the variants are cut down first, without loss.  One edit
    leaves the first or the second half as it was: lines that share no half with another line are out.  The other half
    is cut into pieces, of which all but one are as they were: only pieces whose surroundings two lines share go on,
    and only their characters are deleted.

    A key gets its earliest line by a minimum, and every line of the key is checked against that one alone, so no pairs
    are formed; the edit distance of the two decides.  All lines under a change key are one change apart, and under an
    insertion key each variant is one insertion from the one line without deletion, so the earliest is all that counts.
    For words that holds as a word over ``word`` characters is never deleted; all others are that far apart at most.
    """
    part, length, _ = _ways(word)
    halves = _symbols(docs, word).select("h1", F.explode(F.array_compact(F.array(*_halves(F.col("line"), word)))).alias("key"))
    shared = cut_lineage(_several(halves, "key"))
    pieces = _pieces(_candidates(docs, shared, word), word).groupBy("piece", "h1", "h2", "less", "middle").agg(F.min("place").alias("place"))
    pieces = cut_lineage(pieces)
    pieces = pieces.join(_several(pieces, "piece"), "piece")
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), length("middle")))
    if word:
        spots = F.filter(spots, lambda i: F.length(F.get("middle", i - 1)) <= word)
    shorter = lambda i: F.concat(part("middle", F.lit(1), i - 1), part("middle", i + 1, length("middle")))
    change = F.transform(spots, lambda i: F.struct(F.lit("change").alias("kind"), F.xxhash64(F.col("piece"), i, shorter(i)).alias("variant")))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.xxhash64("piece", F.lit(0), "middle").alias("variant")))
    longer = F.transform(spots, lambda i: F.struct(F.lit("longer").alias("kind"), F.xxhash64(F.col("piece"), F.lit(0), shorter(i)).alias("variant")))
    some = length("middle") > 0
    variants = pieces.withColumn("v", F.explode(F.when(F.col("less") == 1, longer).when(some, F.concat(whole, change)).otherwise(whole))) \
        .select("h1", "h2", "place", "middle", "v.kind", "v.variant")
    variants = cut_lineage(variants.distinct())
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place")))
    first = variants.groupBy("variant").agg(least("change").alias("change"), least("whole").alias("whole"), least("longer").alias("longer")) \
        .where("longer IS NOT NULL AND whole IS NOT NULL OR change IS NOT NULL")
    earlier = F.when(F.col("kind") == "change", F.col("change")).when(F.col("kind") == "whole", F.col("longer")).otherwise(F.col("whole"))
    later = variants.join(first, "variant").withColumn("earlier", earlier).where("earlier < place").select("variant", "h1", "h2", "middle", "earlier")
    partner = variants.select("variant", F.col("place").alias("earlier"), F.col("middle").alias("other")).distinct()
    whole_text = lambda c: F.concat_ws(" ", c) if word else F.col(c)
    most = word + 1 if word else BOUND    # a word that is added brings a space
    return later.join(partner, ["variant", "earlier"]) \
        .where(F.levenshtein(whole_text("middle"), whole_text("other"), most).between(0, most)).select("h1", "h2").distinct()


def _deduplicated(docs: DataFrame, word: int) -> DataFrame:
    names, docs = docs.columns, _numbered(docs)
    firsts = _lines(docs).groupBy("h1", "h2").agg(F.min("place").alias("place"))
    kept = firsts.join(near_lines(docs, word), ["h1", "h2"], "left_anti")
    step = F.lit(PLACE).cast("decimal(38,0)")
    number = ((F.col("place") - F.pmod("place", step)) / step).cast("decimal(28,0)").cast(docs.schema["__number"].dataType)
    kept = kept.withColumn("number", number) \
        .groupBy("number").agg(F.collect_list(F.struct(F.pmod("place", step).cast("int").alias("pos"), F.col("h1"))).alias("__kept"))
    joined = docs.join(kept.withColumnRenamed("number", "__place"), F.col("__number") == F.col("__place"), "left")
    lines = joined.withColumn("__lines", F.split("text", "\n", -1))
    own = F.transform(F.filter(F.coalesce("__kept", F.array().cast("array<struct<pos:int,h1:bigint>>")), lambda k: (k.pos < F.size("__lines"))
                               & (F.xxhash64(F.get("__lines", k.pos)) == k.h1)), lambda k: k.pos)
    blank = F.filter(F.transform("__lines", lambda x, i: F.when(~_visible(x), i)), lambda i: i.isNotNull())
    chosen = lines.withColumn("__chosen", F.array_sort(F.concat(own, blank)))
    text = F.array_join(F.transform("__chosen", lambda i: F.get("__lines", i)), "\n")
    n = F.greatest(F.size("__lines"), F.lit(0))
    return chosen.select(*[(text if c == "text" else F.col(c)).alias(c) for c in names], F.coalesce(n, F.lit(0)).cast("long").alias("__n_lines"),
                         F.coalesce(n - F.size("__chosen"), F.lit(0)).cast("long").alias("__n_removed"))


def dedup_lines(docs: DataFrame, word: int = 0) -> DataFrame:
    """``docs`` with the lines of each text that an earlier line matches removed, and n_lines and n_removed appended.

    Lines are what stands between line feeds.  Two lines match when they are equal or, from ``LEAST`` characters on,
    at most ``BOUND`` edit apart, or, from ``WORDS`` words on, one word of up to ``word`` characters apart (changed, added
    or left out; words are what stands between spaces; 0 leaves this out).  Lines are ordered by doc_id (null last), then position; a line is removed when any
    line before it, kept or not, matches it.  So the earliest of a chain of matching lines always stays.  Blank lines
    match nothing and stay.  The other lines keep their order and are joined by line feeds again.

    Equal lines are merged by two 64-bit hashes before anything else, so frequent lines cost one row per task.  What is
    kept comes back per document as a list of positions, no longer than the document.

    A null text stays null, with 0 lines; an empty text has one blank line.  Rows that share a doc_id, or have none,
    stand in the order of a hash of their texts, and copies one behind the other, so of equal rows one keeps its lines.
    Empty input gives no rows.  Columns named n_lines or n_removed are replaced; all others stay.
    """
    out = _deduplicated(docs.drop("n_lines", "n_removed"), word)
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def drop_repeated_lines(docs: DataFrame, word: int = 0) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs`` and no others."""
    return _deduplicated(docs, word).select(*docs.columns)


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH split AS (
  SELECT row_number() OVER () AS row_no, row_number() OVER (PARTITION BY doc_id ORDER BY md5(text)) AS tie, doc_id, string_split(text, chr(10)) AS lines
  FROM documents),
line AS (
  SELECT row_no, tie, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
seen AS (
  SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS visible,
         (coalesce(doc_id, 9223372036854775807)::HUGEINT * 67108864 + tie) * 2147483648 + pos AS place FROM line),
firsts AS (SELECT line, length(line) AS n, min(place) AS place FROM seen WHERE visible GROUP BY line),
based AS (SELECT *, unnest([n, n - 1]) AS m FROM firsts),
halved AS (
  SELECT *, unnest(['a' || "left"(line, m // 2), 'b' || "right"(line, m - m // 2)]) AS half FROM based WHERE m >= 10),
paired AS (
  SELECT DISTINCT s.line AS a, s.place AS a_place, t.line AS b, t.place AS b_place, s.n AS m, t.n - s.n AS more
  FROM halved s JOIN halved t ON s.m = t.m AND s.half = t.half AND s.n = s.m AND s.line <> t.line),
common AS (
  SELECT *, len(list_filter(range(1, m + 1), lambda i: "left"(a, i) = "left"(b, i))) AS k FROM paired),
near AS (
  SELECT * FROM common WHERE "right"(a, CASE WHEN more = 1 THEN m - k ELSE m - k - 1 END) = "right"(b, CASE WHEN more = 1 THEN m - k ELSE m - k - 1 END)),
gone AS (SELECT b AS line FROM near WHERE a_place < b_place UNION SELECT a FROM near WHERE b_place < a_place),
judged AS (
  SELECT s.*, NOT s.visible OR (s.place = f.place AND s.line NOT IN (SELECT line FROM gone)) AS stays
  FROM seen s LEFT JOIN firsts f ON s.line = f.line),
merged AS (
  SELECT row_no, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS kept
  FROM judged GROUP BY row_no)
SELECT s.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       CASE WHEN m.row_no IS NOT NULL THEN sha256(m.kept) END AS kept_sha256
FROM split s LEFT JOIN merged m ON s.row_no = m.row_no
"""
