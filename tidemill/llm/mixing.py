"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

Every node has an integer weight; a leaf can give at most ``max_epochs`` times its tokens, an inner
node the sum of its children. The total budget enters at the root and is dealt to children in
proportion to their weights. A child that can't take its share takes what it has, and the shortage
goes to its siblings first, by weight again; a node is never given more than its subtree holds, so
only what a whole subtree lacks reaches the level above. Among siblings in order of capacity over
weight this has a closed form by running sums, so a level is one window over its (small) node table.
All arithmetic is on integers; what rounding leaves goes out by running floors.

A leaf with budget b and t tokens gives b div t whole epochs, and of one more epoch, in the seeded
order of that epoch, the longest prefix of documents whose tokens fit into b mod t. The prefix is
found without sorting a leaf: rows fall into buckets by the leading digits of their order key (a hash of
seed, epoch and id), bucket sums find the one bucket where the budget ends, cells of that bucket (a key and
the leading digits of a hash of the text, for ids that repeat or are null) find the cell, and only that
cell's rows are ordered. All sums run over a held table of ids, hashes and token counts; the texts are
read twice, once for it and once for the rows taken.

Defined results: tokens are words; a null text has none, and rows without tokens are never taken; a
null source or language is a node of its own (written as an empty string); equal rows are taken
separately; an empty table gives none. Columns of any name pass through; the added ones get more leading
underscores where the input has ``_domain``, ``_tokens`` or ``_copies`` and are always the last three.
Rows that agree in id and text are ordered by one task if the budget ends among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.cluster import fresh, held

#: Leaves up to this number are sent to every task (under 100 bytes each); beyond it they are joined by shuffle.
FEW_LEAVES = 50_000
#: Rows of a leaf's bucket, about.
BUCKET_ROWS = 2048

LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source when the corpus names none: its number modulo 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))


def lang_weight(lang: Column) -> Column:
    return F.when(lang == "en", F.lit(4)).when(lang.isin("de", "fr", "es"), F.lit(2)).otherwise(F.lit(1)).cast("long")


def spread(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds column ``given`` to rows (parent columns, name, weight, cap, budget of the parent)."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rank = by.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    x = children.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(after))
    full = F.col("cap").cast(wide) * F.col("_w") <= F.col("weight").cast(wide) * (F.col("budget") - F.col("_c"))
    x = x.withColumn("_full", full)
    x = x.withColumn("_rest", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by))
    x = x.withColumn("_free", F.when(F.col("_full"), F.lit(0)).otherwise(F.col("weight")).cast("long"))
    x = x.withColumn("_all", F.sum("_free").over(by)).withColumn("_upto", F.sum("_free").over(rank.rowsBetween(Window.unboundedPreceding, 0)))

    dealt = "(cast({} as decimal(18,0)) * cast(_rest as decimal(19,0))) div cast(greatest(_all, 1) as decimal(18,0))"
    share = F.expr(f"{dealt.format('_upto')} - {dealt.format('(_upto - _free)')}")
    x = x.withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(share).cast("long"))
    return x.drop("_c", "_w", "_full", "_rest", "_free", "_all", "_upto")


def budgets(leaves: DataFrame, weights: dict[str, Column], total: Column, max_epochs: int) -> DataFrame:
    """Budget of every leaf: rows (domain, lang, source, tokens) get ``given``."""
    leaf = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("long"))
    top: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaf.groupBy(*parent, name).agg(F.sum("cap").alias("cap")).withColumn("weight", weights[name])
        if top is None:
            nodes = nodes.withColumn("budget", F.least(total, F.sum("cap").over(Window.partitionBy(F.lit(0)))).cast("long"))
        else:
            nodes = nodes.join(top, parent)
        top = spread(nodes, parent, name).select(*parent, name, F.col("given").alias("budget"))
    return leaves.join(top.withColumnRenamed("budget", "given"), list(LEVELS))


def mix(
    docs: DataFrame, share: float = 0.5, max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    domain: Column | None = None, weights: dict[str, Column] | None = None,
) -> DataFrame:
    """All rows taken at least once, with the input's columns and, last, ``_domain``, ``_tokens``, ``_copies``.

    ``share``: total budget as a share of all tokens, in thousandths.
    """
    weights = weights or {"domain": F.lit(1).cast("long"), "lang": lang_weight(F.col("lang")), "source": F.lit(1).cast("long")}
    domain = domain_of(F.col("source")) if domain is None else domain
    d, lang, source, tokens, copies, name, more, epochs, rest, bucket, room, sub, left, total_ = fresh(
        docs, "domain", "lang", "source", "tokens", "copies", "id", "text_hash", "epochs", "rest", "bucket", "room", "cell", "left", "sum"
    )
    leaf = [d, lang, source]
    rows = docs.withColumns(
        {
            d: domain, lang: F.coalesce(F.col("lang"), F.lit("")), source: F.coalesce(F.col("source"), F.lit("")), tokens: token_count(F.col(text_col)),
            name: F.coalesce(F.col(id_col).cast("string"), F.lit("")), more: F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))),
        }
    ).where(F.col(tokens) > 0)
    light = held(rows.select(*leaf, tokens, name, more))
    sums = held(light.groupBy(F.col(d).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("n")))
    whole, most, n_leaves = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    total = F.lit(int(whole) * round(share * 1000) // 1000).cast("long")
    plan = budgets(sums, weights, total, max_epochs)
    plan = held(
        plan.select(
            *[F.col(c).alias(x) for c, x in zip(LEVELS, leaf, strict=True)],
            F.expr("given div tokens").cast("long").alias(epochs),
            (F.col("given") % F.col("tokens")).cast("long").alias(rest),
        )
    )
    hint = F.broadcast if n_leaves <= FEW_LEAVES else (lambda x: x)
    digits = 1
    while most > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    # the order of the epoch that is cut, by digits of a hash that any engine has
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(epochs) + 1).cast("string"), F.col(name)))
    head, cell = F.substring(key, 1, digits), F.concat(key, F.substring(F.lpad(F.col(more), 16, "0"), 1, digits))

    def ends(parts: DataFrame, by: str, limit: str) -> DataFrame:
        """For every leaf the first of its parts (sums of tokens) at which the limit is passed, and what is left for it."""
        upto = F.sum(total_).over(Window.partitionBy(*leaf).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        over = parts.withColumn(left, F.col(limit) - upto + F.col(total_)).where(F.col(left) < F.col(total_))
        first = over.groupBy(*leaf).agg(F.min(F.struct(F.col(by), F.col(left))).alias(by))
        return first.select(*leaf, F.col(f"{by}.{by}").alias(by), F.col(f"{by}.{left}").alias(room))

    def summed(x: DataFrame, by: str, limit: str) -> DataFrame:
        return x.groupBy(*leaf, by).agg(F.sum(tokens).alias(total_), F.first(limit).alias(limit))

    cut = held(ends(summed(light.join(hint(plan), leaf).withColumn(bucket, head), bucket, rest), bucket, rest))
    inner = light.join(hint(plan.drop(rest)), leaf).withColumn(bucket, head).join(hint(cut), [*leaf, bucket]).withColumn(sub, cell)
    cells = summed(inner.withColumnRenamed(room, rest), sub, rest)
    cut = held(cut.drop(room).join(ends(cells, sub, rest), leaf, "left"))
    rows = rows.join(hint(plan), leaf).join(hint(cut), leaf, "left")
    # cells sort as their buckets do; a leaf that no cell ends takes all its rows
    before = F.col(bucket).isNull() | (head < F.col(bucket)) | ((head == F.col(bucket)) & F.coalesce(cell < F.col(sub), F.lit(True)))
    here = F.coalesce((head == F.col(bucket)) & (cell == F.col(sub)), F.lit(False))
    outside = rows.where(~here).withColumn(copies, F.col(epochs) + F.when(before, 1).otherwise(0))
    ordered = Window.partitionBy(*leaf).orderBy(more, tokens).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.where(here).withColumn(total_, F.sum(tokens).over(ordered))
    inside = inside.withColumn(copies, F.col(epochs) + F.when(F.col(total_) <= F.col(room), 1).otherwise(0)).drop(total_)
    out = outside.unionByName(inside).where(F.col(copies) > 0)
    return out.select(*docs.columns, F.col(d), F.col(tokens), F.col(copies).cast("long").alias(copies))


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """The taken rows with the input's columns alone, each as often as it was taken."""
    copies = mixed.columns[-1]
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*mixed.columns[:-3])


#: The same result in SQL, for unique ids: (doc_id, domain, lang, source, n_tokens, copies).
MIX_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) = '' THEN 'other'
      ELSE 'd' || CAST(CAST(regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) AS INTEGER) % 4 AS VARCHAR) END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
docs AS (SELECT * FROM words WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 4 AS BIGINT) AS cap FROM docs GROUP BY ALL),
r0 AS (SELECT (CAST(sum(tokens) AS BIGINT) * 500) // 1000 AS total, CAST(sum(cap) AS BIGINT) AS cap FROM leaves),
d0 AS (SELECT l.domain, CAST(sum(l.cap) AS BIGINT) AS cap, CAST(1 AS BIGINT) AS weight, (SELECT least(total, cap) FROM r0) AS budget FROM leaves l GROUP BY l.domain),
d1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM d0),
d2 AS (SELECT *, CAST(cap AS HUGEINT) * w <= CAST(weight AS HUGEINT) * (budget - c) AS filled FROM d1),
d3 AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER () AS rest, CASE WHEN filled THEN 0 ELSE weight END AS free FROM d2),
d4 AS (SELECT *, sum(free) OVER () AS allw, sum(free) OVER (ORDER BY cap / weight, domain ROWS UNBOUNDED PRECEDING) AS upto FROM d3),
d5 AS (SELECT domain, CASE WHEN filled THEN cap ELSE (upto * rest) // greatest(allw, 1) - ((upto - free) * rest) // greatest(allw, 1) END AS budget FROM d4),
l0 AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, CAST(CASE WHEN l.lang = 'en' THEN 4 WHEN l.lang IN ('de', 'fr', 'es') THEN 2 ELSE 1 END AS BIGINT) AS weight, any_value(d5.budget) AS budget
  FROM leaves l JOIN d5 ON l.domain = d5.domain GROUP BY l.domain, l.lang),
l1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM l0),
l2 AS (SELECT *, CAST(cap AS HUGEINT) * w <= CAST(weight AS HUGEINT) * (budget - c) AS filled FROM l1),
l3 AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY domain) AS rest, CASE WHEN filled THEN 0 ELSE weight END AS free FROM l2),
l4 AS (SELECT *, sum(free) OVER (PARTITION BY domain) AS allw, sum(free) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS UNBOUNDED PRECEDING) AS upto FROM l3),
l5 AS (SELECT domain, lang, CASE WHEN filled THEN cap ELSE (upto * rest) // greatest(allw, 1) - ((upto - free) * rest) // greatest(allw, 1) END AS budget FROM l4),
s0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, CAST(1 AS BIGINT) AS weight, l5.budget FROM leaves l JOIN l5 ON l.domain = l5.domain AND l.lang = l5.lang),
s1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM s0),
s2 AS (SELECT *, CAST(cap AS HUGEINT) * w <= CAST(weight AS HUGEINT) * (budget - c) AS filled FROM s1),
s3 AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang) AS rest, CASE WHEN filled THEN 0 ELSE weight END AS free FROM s2),
s4 AS (SELECT *, sum(free) OVER (PARTITION BY domain, lang) AS allw, sum(free) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING) AS upto FROM s3),
s5 AS (SELECT domain, lang, source, tokens, CASE WHEN filled THEN cap ELSE (upto * rest) // greatest(allw, 1) - ((upto - free) * rest) // greatest(allw, 1) END AS given FROM s4),
taken AS (SELECT d.*, CAST(s5.given // s5.tokens AS BIGINT) AS epochs, s5.given % s5.tokens AS rest,
    sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('42:' || CAST(CAST(s5.given // s5.tokens + 1 AS BIGINT) AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN s5 ON d.domain = s5.domain AND d.lang = s5.lang AND d.source = s5.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM taken WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
