"""License scans by diagonal voting.

Every rolling two-word gram of every text is joined to the positions that the
gram has in a list of template phrases.  A hit votes for the diagonal
``word position - template position``; an exact copy of a template puts all
its votes on one diagonal, an edited copy on a few neighbouring ones, which
are merged and verified by the share of the template that they cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.llm.common import ASCII_UPPER, WORD_SEPARATORS, ascii_lower, table
from loadcast.session import cut_lineage


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool  # counts only where every word stands, as a base phrase does


def phrase(text: str, label: str, exact: bool = False) -> Template:
    return Template(label, tuple(text.split()), exact)


# The base phrases and the notices, in lower-case words.
TEMPLATES: tuple[Template, ...] = (
    phrase("cc by", "cc-by", exact=True),
    phrase("general public license", "gpl", exact=True),
    phrase("all rights reserved", "reserved", exact=True),
    phrase("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    phrase("licensed under the creative commons attribution 4 0 international license", "cc-by-4.0"),
    phrase("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    phrase("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    phrase("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    phrase("licensed under the apache license version 2 0", "apache-2.0"),
    phrase("released under the mit license", "mit"),
    phrase("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    phrase("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    phrase("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
)
SLACK = 2          # neighbouring diagonals at most this far apart are one span
COVERAGE = 0.8     # share of a template's grams that a span must hold
MAX_TEMPLATE_WORDS = 200_000  # bound of the broadcast table of template positions


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row per gram position of each template, and row -1, which every text hits once."""
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template needs two words or more")
    rows = [(-1, 0, "", "")] + [
        (n, p, t.words[p], t.words[p + 1]) for n, t in enumerate(templates) for p in range(len(t.words) - 1)
    ]
    grams = spark.createDataFrame(rows, "template int, template_at int, first string, second string")
    return grams.withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("first", "second")))


def gram_hits(docs: DataFrame, doc_id: str, text: str, templates: tuple[Template, ...]) -> DataFrame:
    """Rows (id, text_hash, n_words, template, template_at, at): where grams of
    the texts meet template positions, and one row of template -1 per text."""
    spark = docs.sparkSession
    words = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
        .select("id", F.xxhash64("t").alias("text_hash"), F.split(ascii_lower("t"), WORD_SEPARATORS, -1).alias("w"))
        # separators at either end leave an empty first or last piece
        .withColumn("skip", F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0))
        .withColumn("n_words", F.greatest(F.lit(0), F.size("w") - F.col("skip") - F.when(F.element_at("w", -1) == "", 1).otherwise(0)))
        .withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - 2, F.lit(-1)))))
        .withColumn("one", F.get("w", F.col("at") + F.col("skip")))
        .withColumn("two", F.get("w", F.col("at") + F.col("skip") + 1))
        .withColumn("gram", F.when(F.col("at") < 0, F.lit(0)).otherwise(F.xxhash64("one", "two")))
    )
    # the table's size is checked in template_grams
    grams = F.broadcast(template_grams(spark, templates))
    real = (words["at"] < 0) == (grams["template"] < 0)
    same = (words["at"] < 0) | ((words["one"] == grams["first"]) & (words["two"] == grams["second"]))
    return words.join(grams, (words["gram"] == grams["gram"]) & real & same).select(
        "id", "text_hash", "n_words", "template", "template_at", "at"
    )


def spans(hits: DataFrame, templates: tuple[Template, ...], slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans (id, text_hash, template, label, exact, start, words_long,
    coverage): votes summed by diagonal, neighbouring diagonals merged."""
    spark = hits.sparkSession
    facts = F.broadcast(spark.createDataFrame(
        [(n, t.label, t.exact, len(t.words) - 1) for n, t in enumerate(templates)],
        "template int, label string, exact boolean, grams int",
    ))
    diagonals = (
        hits.where("template >= 0")
        .groupBy("id", "text_hash", "template", (F.col("at") - F.col("template_at")).alias("diagonal"))
        .agg(F.collect_set("template_at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
        .join(facts, "template")
    )
    along = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    return (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(along))
        .groupBy("id", "text_hash", "template", "label", "exact", "grams", "island")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"),
            F.min("first").cast("long").alias("start"),
            (F.max("last") + 2 - F.min("first")).cast("long").alias("words_long"),
        )
        .withColumn("coverage", F.col("votes") / F.col("grams"))
        .where(F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(F.col("coverage") >= coverage))
        .drop("island", "votes", "grams")
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
                  slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: word count, places and labels of the exact
    phrases, labels of all verified spans and the best coverage as a score.

    A null or empty text has no words, no labels and score 0.  Rows are told
    apart by id and text, so repeated ids, null ids and repeated rows each
    keep their own row.  Other columns are not looked at.
    """
    # read twice: for the word counts and for the spans
    hits = cut_lineage(gram_hits(docs, doc_id, text, templates))
    found = (
        spans(hits, templates, slack, coverage)
        .groupBy(F.col("id").alias("fid"), F.col("text_hash").alias("fhash"))
        .agg(
            F.count(F.when(F.col("exact"), 1)).alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    texts = hits.where("template < 0").select("id", "text_hash", "n_words")
    return texts.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("text_hash") == F.col("fhash")), "left").select(
        F.col("id").alias(doc_id), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan_licenses(table(spark, root, "documents", "doc_id", "text"))


def op1_sql(templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK, coverage: float = COVERAGE) -> str:
    """DuckDB twin: the same votes by unnesting every word."""
    grams = ", ".join(
        f"({n}, {p}, '{t.words[p]}', '{t.words[p + 1]}')" for n, t in enumerate(templates) for p in range(len(t.words) - 1)
    )
    facts = ", ".join(f"({n}, '{t.label}', {str(t.exact).lower()}, {len(t.words) - 1})" for n, t in enumerate(templates))
    return f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS one, generate_subscripts(w, 1) - 1 AS pos FROM texts),
pairs AS (SELECT a.doc_id, a.pos, a.one, lead(a.one) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM words a),
grams(template, template_at, first, second) AS (VALUES {grams}),
facts(template, label, exact, grams) AS (VALUES {facts}),
diagonals AS (
  SELECT doc_id, template, pos - template_at AS diagonal, list(template_at) AS votes, min(pos) AS first
  FROM pairs JOIN grams ON pairs.one = grams.first AND pairs.two = grams.second GROUP BY 1, 2, 3),
marked AS (
  SELECT *, CASE WHEN coalesce(exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {slack}, true)
                 THEN 1 ELSE 0 END AS new FROM diagonals JOIN facts USING (template)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked),
merged AS (
  SELECT doc_id, label, exact, grams, len(list_distinct(flatten(list(votes)))) AS votes, min(first) AS start
  FROM islands GROUP BY doc_id, template, label, exact, grams, island),
kept AS (
  SELECT *, votes / grams AS coverage FROM merged
  WHERE CASE WHEN exact THEN votes = grams ELSE votes / grams >= {coverage} END),
found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(coverage) AS score
  FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts LEFT JOIN found USING (doc_id)"""
