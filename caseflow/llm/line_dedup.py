"""Line deduplication by an exact set-similarity join, in DataFrame operations
only.

Lines are compared as sets of lower-cased words; two lines match when their
Jaccard similarity is at least ``percent`` / 100.  A line goes if an earlier
line matches it (order: document, then position), whether or not that line
goes itself.  Lines of fewer than ``min_words`` distinct words carry no
identity of their own and always stay; by default every line with a word
counts.  Rows with the same doc_id rank alike: neither is earlier.

The join: tokens of a line are ordered by rarity, and only the first
``n - ceil(t n) + 1`` are indexed (prefix filter): matching sets share one of
those.  Sizes must be within the similarity (length filter), and the tokens
left after the shared one must suffice for the overlap (positional filter).
Survivors are verified on the full sets.  Equal sets are one class from the
start, so a line with many copies enters the join once.

Two more exact tests run inside the join: of the smaller set of a pair a
shorter prefix suffices, and parities of the sets bound from below how
many tokens they do not share: the bits in which two parities differ are the
parity of the tokens in one set only, however large the sets are.  Larger sets
have longer parities, 64 to 256 bits: with 64, two lines of 150 words that share
one would pass, so that pairs grew with the square of the corpus.

Variants of one line are not paired all with all.  Each class that may match
another joins one group, and a group's core are the tokens that most of its
members have.  A member is its difference from the core: of two members
without a shared token in these, the number of tokens not shared is the sum of
the differences' sizes, so their matches are counted from the group's sizes.
Pairs are made of members that need a shared token to match, and across groups.
Which groups there are decides the cost only.

Rarity: all words of all lines are counted in hash buckets, and a word's
rarity is its bucket's count on a logarithmic scale.  Any fixed order of the
tokens keeps the prefix filter exact; the estimate only decides how selective
it is.  The counts have a fixed size and reach the tasks as one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import sized, written

PERCENT, MIN_WORDS = 80, 1
_BUCKETS, _SUB = 1 << 16, 32
#: Sets of more tokens than these have parities of 128 and 256 bits.
_WIDE = (96, 208)
_WORDS = ("b0", "b1", "b2", "b3")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), pos, line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _split(line: Column) -> Column:
    """Lower-cased words of a text of one line or more."""
    odd = r"[\t\n\x0B\f\r]"
    blank = F.when(line.rlike(odd), F.regexp_replace(line, odd, " ")).otherwise(line)
    return F.array_remove(F.split(F.lower(blank), " "), "")


def _rarity(docs: DataFrame) -> DataFrame:
    """How frequent words are, as one row of fixed size, whatever the corpus.

    All words are counted in 2^21 hash buckets; ``ranks`` has the rarity class
    of each, 0 to 127, four to a doubling.  Plans refer to the row by a
    subquery: their texts, kept by the driver, do not hold it."""
    counts = (_lines(docs).select(F.explode(_split(F.col("line"))).alias("w"))
              .groupBy(F.xxhash64("w").bitwiseAND(F.lit(_SUB * _BUCKETS - 1)).cast("int").alias("b"))
              .agg(F.count(F.lit(1)).alias("c")))
    rank = F.least(F.lit(127), F.floor(4 * F.log2(F.col("c") + 1.0))).cast("tinyint")
    none = F.lit(0).cast("tinyint")
    # 32 buckets are an entry; each entry is there, with or without a word
    every = docs.sparkSession.range(_BUCKETS).select((F.col("id") * _SUB).cast("int").alias("b"), none.alias("r"))
    sub, entry = F.col("b").bitwiseAND(F.lit(_SUB - 1)), F.floor(F.col("b") / _SUB).cast("int")
    entries = (counts.select("b", rank.alias("r")).unionByName(every).groupBy(entry.alias("entry"))
               .agg(*(F.max(F.when(sub == k, F.col("r"))).alias(f"r{k}") for k in range(_SUB)))
               .select("entry", F.array(*(F.coalesce(f"r{k}", none) for k in range(_SUB))).alias("r")))

    def joined(key):
        return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(key, "r"))), lambda x: x["r"])).alias("r")
    blocks = entries.groupBy(F.shiftright("entry", 8).alias("block")).agg(joined("entry"))
    return written(blocks.agg(joined("block")).select(F.col("r").alias("ranks")), "ranks")


def _ranked(lines: DataFrame, rarity: DataFrame) -> DataFrame:
    """``lines`` with ``ranks``, the table of rarities, for one call of
    ``_tokens``.  Named once, it is no column of the rows that Spark makes: the
    optimizer puts the subquery in its place."""
    return lines.select("*", rarity.scalar().alias("ranks"))


def _tokens(line: Column, rarity: bytes | Column) -> Column:
    """Distinct tokens of a line, rarest first: 7 bits of rarity above 56 bits
    of hash, so that sorting the numbers sorts by rarity.

    ``rarity`` is the column of ``_rarity``, or a table of three bytes for
    32 buckets: the most frequent one, its class, the class of the others."""
    hashes = F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w)))

    def token(h, rare):
        return F.shiftleft(rare.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    def looked_up(h):
        at = h.bitwiseAND(F.lit(_BUCKETS - 1)).cast("int") * 3 + 1

        def byte(k):
            return F.ascii(F.substring(F.lit(rarity), at + k, F.lit(1)).cast("string"))
        # the table is named twice only: each time it is as long in the plan's text
        return byte(F.when(F.shiftright(h, 16).bitwiseAND(F.lit(_SUB - 1)) == byte(0), 1).otherwise(2))

    def tokens(ranks):
        return F.transform(hashes, lambda h: token(h, F.coalesce(
            F.get(ranks, h.bitwiseAND(F.lit(_SUB * _BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint"))))
    if isinstance(rarity, bytes):
        return F.sort_array(F.transform(hashes, lambda h: token(h, looked_up(h))))
    # the column is named once (see _ranked), the function's argument as often as there are words
    return F.sort_array(F.get(F.transform(F.array(rarity), tokens), F.lit(0)))


def _bits(tokens: Column) -> Column:
    """64-bit parity of a token set: each token turns over one bit by its hash."""
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))))


def _part(tokens: Column, k: int, of: int) -> Column:
    """The tokens of part ``k`` of ``of``."""
    return F.filter(tokens, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(of - 1)) == k)


def _parities(tokens: Column, n: Column) -> list[Column]:
    """b0 to b3: the parity of a set, for larger sets (``_WIDE``) that of each
    half or quarter of it; else 0."""
    none = F.lit(0).cast("bigint")
    one, two = n <= _WIDE[0], n <= _WIDE[1]

    def word(k):
        out = F.when(one, _bits(tokens) if k == 0 else none)
        return out.when(two, _bits(_part(tokens, k, 2)) if k < 2 else none).otherwise(_bits(_part(tokens, k, 4))).alias(f"b{k}")
    return [word(k) for k in range(4)]


def _order() -> Column:
    """Place of a line in the corpus as one number: doc_id, then position."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    return (doc * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")


def line_classes(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, count_links: bool = True) -> DataFrame:
    """The lines of at least ``min_words`` distinct words that have a copy or a
    match: doc_id, key, pos, n, cls (the class of its token set), n_links
    (other classes that match it) and dropped.

    Without ``count_links`` the verdicts are the same, but n_links counts only
    the links that were needed for them: classes whose group already holds an
    earlier match are not paired in it again."""
    rarity = _rarity(docs)
    n = F.size("t")
    prefix = F.transform(F.slice("t", 1, n - F.ceil(n * percent / 100 - 1e-9).cast("int") + 1), lambda x: x.bitwiseXOR(
        F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # the row number keeps the filter above the tokens: pushed below, it would
    # make them twice
    lines = (_ranked(_lines(docs), rarity)
             .select("doc_id", "key", "pos", _tokens(F.col("line"), F.col("ranks")).alias("t"),
                     F.monotonically_increasing_id().alias("row"))
             .where((n >= min_words) & (F.col("row") >= 0))
             .select("doc_id", "key", "pos", n.alias("n"), F.xxhash64("t").alias("cls"),
                     *_parities(F.col("t"), n), prefix.alias("prefix")))
    lines = written(lines, "lines")
    classes = written(lines.groupBy("cls").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = _firsts(lines, classes)
    groups = _groups(firsts, percent)
    across = _candidates(firsts, groups, percent)
    sets = _sets(groups.select("cls").union(across.select(F.explode(F.array("u", "v")))).distinct(), firsts, docs, rarity)
    deltas = _deltas(sets, groups, percent)
    sure = _sure(deltas)
    links = _verified(across.unionByName(_inside(deltas, sure, percent, count_links)), sets, percent)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    earliest = (both.join(classes.select(F.col("cls").alias("v"), "first"), "v")
                .select(F.col("u").alias("cls"), F.col("first").alias("other"), F.lit(1).cast("long").alias("n_links"))
                .unionByName(sure.where("n_links > 0").select("cls", "other", "n_links"))
                .groupBy("cls").agg(F.min("other").alias("other"), F.sum("n_links").alias("n_links")))
    verdict = (classes.join(earliest, "cls", "left").where("copies > 1 or n_links > 0")
               .select("cls", F.least("first", F.coalesce("other", "first")).alias("first"),
                       F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return (lines.drop("prefix", *_WORDS).join(sized(written(verdict, "verdicts"), 500_000), "cls")
            .select("doc_id", "key", "pos", "n", "cls", "n_links", (_order() > F.col("first")).alias("dropped")))


def _firsts(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, n, parities, prefix of each class and doc_id, key, pos of the line that
    comes first."""
    return written(lines.withColumn("at", _order())
                   .join(classes.select("cls", F.col("first").alias("at")), ["cls", "at"], "left_semi")
                   .select("cls", "n", *_WORDS, "doc_id", "key", "pos", "prefix"), "firsts")


def _filters(percent: int) -> Column:
    """Length, positional and parity filter of the postings a and b."""
    total = F.col("a.n") + F.col("b.n")
    rest = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p"))

    def fits(words):
        """Tokens that are in one set only: as many as differing bits at least."""
        pairs = ([F.col(f"{s}.b{k}") for s in "ab" for k in same] for same in words)
        differ = sum((F.bit_count(reduce(Column.bitwiseXOR, x)) for x in pairs), F.lit(0))
        return (100 + percent) * (total - differ) >= 2 * percent * total
    # sets of unequal width are compared by the width of the smaller one: parts add up to their parity
    return ((F.col("a.token") == F.col("b.token"))
            & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * rest >= percent * total)
            & fits([range(4)])
            & ((F.least("a.n", "b.n") <= _WIDE[0]) | fits([(0, 2), (1, 3)]))
            & ((F.least("a.n", "b.n") <= _WIDE[1]) | fits([(k,) for k in range(4)])))


def _indexed(n: Column, p: Column, percent: int) -> Column:
    """The place is in the prefix that suffices for sets that are not larger."""
    return (100 + percent) * (n - p) >= 2 * percent * n


def _groups(firsts: DataFrame, percent: int) -> DataFrame:
    """cls, g, size: the group of each class that passes the filters with the
    class of the smallest document under one of its rarest tokens, or is such
    a class itself; of several groups the one most classes could join."""
    # rows without doc_id come first
    doc = F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc")
    posts = (firsts.select("cls", "n", *_WORDS, doc, F.posexplode("prefix").alias("p", "token"))
             .where(_indexed(F.col("n"), F.col("p"), percent)))
    centre = (posts.groupBy("token").agg(F.min_by("cls", "doc").alias("cls"), F.count(F.lit(1)).alias("c")).where("c > 1")
              .select("token", "cls", F.lit(0).alias("p")).join(firsts.select("cls", "n", *_WORDS), "cls"))
    near = (posts.alias("a").join(centre.alias("b"), _filters(percent) & (F.col("a.cls") != F.col("b.cls")))
            .select(F.col("a.cls").alias("cls"), F.col("b.cls").alias("g")).distinct())
    near = written(near, "stars")
    near = near.union(near.select("g", "g").distinct())
    size = near.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    best = written(near.join(size, "g").groupBy("cls").agg(F.max(F.struct("size", "g")).alias("m")).select("cls", "m.g"), "best")
    size = best.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(best.join(size, "g").select("cls", "g", "size"), "groups")


def _candidates(firsts: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes, not of one group, that pass the prefix, length,
    positional and parity filters.  A function of its own: when it returns,
    nothing refers to its shuffles any more and Spark can drop their files."""
    known = sized(groups.select("cls", "g"), 500_000)
    posts = (firsts.join(known, "cls", "left")
             .select("cls", "n", *_WORDS, "g", F.posexplode("prefix").alias("p", "token")))
    a, b = posts.alias("a"), posts.alias("b")
    # a is the larger set; of the smaller one the first n - ceil(2t / (1 + t) n) + 1
    # tokens suffice, which the positional filter sees to: both sides are the same
    # rows and are shuffled once
    larger = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.cls") > F.col("b.cls")))
    apart = F.coalesce(F.col("a.g") != F.col("b.g"), F.lit(True))
    pairs = (a.join(b, _filters(percent) & larger & apart)
             .select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")).distinct())
    return written(pairs, "pairs")


def _sets(ids: DataFrame, firsts: DataFrame, docs: DataFrame, rarity: DataFrame) -> DataFrame:
    """One row per class of ``ids``: cls, first (place of the line that comes
    first), t (its token set), n, and four parities of 64 bits."""
    ids = written(ids, "ids")
    # lines are found again by one hash of their place (half the memory of the
    # place itself); a line found in error has another class and goes below
    places = written(firsts.join(sized(ids, 500_000), "cls")
                     .select("cls", F.xxhash64("doc_id", "key", "pos").alias("spot"), F.xxhash64("doc_id", "key").alias("own"))
                     .distinct(), "places")
    keys = places.select("own").distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = docs.select("doc_id", "text").join(sized(keys, 500_000), F.xxhash64(F.col("doc_id").cast("long"), text)
                                              == F.col("own"), "left_semi")
    found = (_lines(some).withColumn("spot", F.xxhash64("doc_id", "key", "pos"))
             .join(sized(places.select("cls", "spot"), 500_000), "spot"))
    sets = (_ranked(found, rarity)
            .select("cls", _order().alias("first"), _tokens(F.col("line"), F.col("ranks")).alias("t")))
    sets = written(sets.select("cls", "first", "t", F.size("t").alias("n"), (F.xxhash64("t") == F.col("cls")).alias("same"),
                               *(_bits(_part(F.col("t"), k, 4)).alias(f"b{k}") for k in range(4))), "sets").where("same").drop("same")
    rows, classes = sets.agg(F.count(F.lit(1)), F.count_distinct("cls")).first()
    return sets if rows == classes else written(sets.dropDuplicates(["cls"]), "sets_once")    # repeated documents


def _deltas(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The classes in groups as differences from their group's core: cls, g,
    first, n, parities, d (the tokens only one of class and core has) and x,
    with which two members without a shared token in d match if and only if
    the sum of their x is not positive."""
    members = sets.join(sized(groups, 500_000), "cls")
    core = (members.select("g", "size", F.explode("t").alias("y")).groupBy("g", "size", "y")
            .agg(F.count(F.lit(1)).alias("c")).where("2 * c > size").groupBy("g").agg(F.collect_list("y").alias("core")))
    core_or_none = F.coalesce("core", F.array().cast("array<bigint>"))
    d = F.sort_array(F.concat(F.array_except("t", core_or_none), F.array_except(core_or_none, "t")))
    deltas = (members.join(core, "g", "left").select("cls", "g", "first", "n", "b0", "b1", "b2", "b3", d.alias("d"))
              .withColumn("x", ((100 + percent) * F.size("d") - (100 - percent) * F.col("n")).cast("long")))
    return written(deltas, "deltas")


def _sure(deltas: DataFrame) -> DataFrame:
    """Per class in a group: cls, n_links (the members that match it by sizes
    alone), other (the place of the earliest of them or of itself, if it
    would count itself) and settled (one of them is earlier).  Members of
    equal x are one row."""
    same = deltas.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"), F.min("first").alias("f"))
    asked = (same.select("g", F.col("x").alias("at"), F.lit(0).alias("kind"), "c", "f", "x")
             .unionByName(same.select("g", (-F.col("x")).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("c"),
                                      F.lit(None).cast("decimal(38,0)").alias("f"), "x")))
    w = Window.partitionBy("g").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (asked.select("g", "x", "kind", F.sum("c").over(w).alias("c"), F.min("f").over(w).alias("other"))
             .where("kind = 1 and c > 0"))
    own = F.when(F.col("x") <= 0, 1).otherwise(0)
    return written(deltas.select("cls", "g", "x", "first").join(found, ["g", "x"])
                   .select("cls", (F.col("c") - own).alias("n_links"), "other", (F.col("other") < F.col("first")).alias("settled")),
                   "sure")


def _inside(deltas: DataFrame, sure: DataFrame, percent: int, count_links: bool) -> DataFrame:
    """Pairs (u, v) of one group that match only with a shared token in their
    differences, and by their parities may; without ``count_links`` only
    those whose later class is not settled."""
    wanted, extra = F.lit(True), []
    if not count_links:
        settled = sized(sure.where("settled").select("cls", "settled"), 500_000)
        deltas = deltas.join(settled, "cls", "left").withColumn("open", F.col("settled").isNull())
        extra = ["first", "open"]
        wanted = ((F.col("a.open") & (F.col("a.first") >= F.col("b.first")))
                  | (F.col("b.open") & (F.col("b.first") >= F.col("a.first"))))
    posts = deltas.select("cls", "g", "n", "x", "b0", "b1", "b2", "b3", F.size("d").alias("k"), *extra,
                          F.posexplode("d").alias("p", "y"))
    a, b = posts.alias("a"), posts.alias("b")
    need = F.col("a.x") + F.col("b.x")
    rest = F.least(F.col("a.k") - F.col("a.p"), F.col("b.k") - F.col("b.p"))
    differ = sum((F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(4)), F.lit(0))
    pairs = (a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.cls") > F.col("b.cls"))
                    & (need > 0) & (2 * (100 + percent) * rest >= need) & wanted
                    & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
                    & ((100 + percent) * differ <= (100 - percent) * (F.col("a.n") + F.col("b.n"))))
             .select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")).distinct())
    return written(pairs, "inside")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full token sets reach the similarity."""
    # parities of 256 bits bound the overlap from above: most pairs end here,
    # and only the others carry whole sets through a shuffle
    narrow = ["cls", "n", "b0", "b1", "b2", "b3"]
    left, right = (sets.select(*(F.col(c).alias(s if c == "cls" else f"{c}_{s}") for c in narrow)) for s in "uv")
    differ = sum((F.bit_count(F.col(f"b{k}_u").bitwiseXOR(F.col(f"b{k}_v"))) for k in range(4)), F.lit(0))
    total = F.col("n_u") + F.col("n_v")
    pairs = written(pairs.join(left, "u").join(right, "v")
                    .where((100 + percent) * (total - differ) >= 2 * percent * total).select("u", "v"), "near_pairs")
    left, right = (sets.select(F.col("cls").alias(s), F.col("t").alias(f"t{s}")) for s in "uv")
    both = F.size(F.array_intersect("tu", "tv"))
    return written(pairs.join(left, "u").join(right, "v")
                   .where(100 * both >= percent * (F.size("tu") + F.size("tv") - both)).select("u", "v"), "links")


def dedup_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
                drop_emptied: bool = False, count_links: bool = True) -> DataFrame:
    """``docs`` with all columns, later matches removed from ``text``, and the
    columns n_lines, n_removed and n_links (links of its lines' classes).

    Input columns of these names are replaced.  Long texts are taken whole.
    Null texts stay null and empty texts empty; rows with equal doc_id and
    text are one document (they keep the same lines); rows without doc_id come
    first in the order; an empty table gives an empty result.  With
    ``drop_emptied`` a document that had words and whose every line with words
    was removed goes.  Without ``count_links`` the texts are the same and
    n_links is a lower bound (``line_classes``).
    """
    # positions of one document: lists as long as its own text.  Repeated rows
    # give each position as often as the document is there
    per = (line_classes(docs, percent, min_words, count_links).where("dropped or n_links > 0").groupBy("doc_id", "key")
           .agg(F.collect_set(F.when(F.col("dropped"), F.col("pos"))).alias("gone"),
                F.expr("sum(n_links) div (count(1) div size(collect_set(pos)))").alias("links")))
    per = written(per.select(F.col("doc_id").alias("_d"), F.col("key").alias("_x"), "gone", "links"), "removed")
    # few removals in all (counted) spare the texts a shuffle
    few = per.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= 2_000_000
    per = sized(per, 500_000) if few else per
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)),
                          F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    full = renamed.withColumn("_key", F.xxhash64(F.coalesce("_text", F.lit(""))))
    full = full.join(per, (F.col("_key") == F.col("_x")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    lines = F.split("_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    full = full.withColumn("_lines", lines)
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
                  ).otherwise(F.col("_text"))
    full = full.withColumn("_new", text)
    if drop_emptied:
        full = full.where((F.coalesce(F.size("gone"), F.lit(0)) <= 0) | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    at = docs.columns.index("text")
    own = ("n_lines", "n_removed", "n_links")
    return full.select(*(F.col("_new" if i == at else f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own),
                       F.size("_lines").cast("long").alias("n_lines"),
                       F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                       F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


ORACLE_SQL = """
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS k, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS line
           FROM (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, k, pos, line, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+'))) AS t
      FROM l),
u AS (SELECT t, min((doc_id, pos)) AS f, row_number() OVER (ORDER BY t) AS c FROM t WHERE len(t) >= 1 GROUP BY t),
w AS (SELECT c, len(t) AS n, unnest(t) AS x FROM u),
p AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m
      FROM w a JOIN w b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.c, b.c),
j AS (SELECT a, b FROM p WHERE 100 * m >= 80 * (na + nb - m)),
e AS (SELECT a, min(u.f) AS o, count(*) AS n FROM j JOIN u ON u.c = j.b GROUP BY a),
z AS (SELECT u.t, least(f, coalesce(o, f)) AS f, coalesce(n, 0) AS n FROM u LEFT JOIN e ON u.c = e.a),
g AS (SELECT t.doc_id, t.pos, t.line, coalesce((t.doc_id, t.pos) > z.f, false) AS gone, coalesce(z.n, 0) AS n
      FROM t LEFT JOIN z ON t.t = z.t)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed, sum(n)::BIGINT AS n_links
FROM g GROUP BY doc_id
"""


def rewrite(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the same columns: later matches are removed from ``text``,
    documents left without a word by that go, and ``n_chars`` (if there)
    is the length of the new text where lines were removed."""
    out = dedup_lines(docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)),
                                  F.col("doc_id"), F.col("text")), percent, min_words, drop_emptied=True,
                      count_links=False)
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        old = F.col(f"c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
