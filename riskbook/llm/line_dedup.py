r"""Drop lines that many documents share, with DataFrame functions only.

Every text is split at \n. A line's key is the line without white space at its ends, A-Z in
lower case. Keys found in at least ``least_documents`` documents lose all their lines in
every document; the others stay in their order, joined by \n.

Keys move as two 64-bit hashes and never as text: (key, document) pairs are made distinct,
counted by key with map-side sums, and the keys over the threshold are joined back to the
pairs, which gives each document's set of keys to drop. Only that join and the counting see a
common key, and both split it: sums are pre-aggregated, and the pairs are dealt by key and
a salt, with the few frequent keys repeated for each salt. Each text is then moved once, to
its set.

Defined cases: a null or empty text is one empty line; an empty line's key is shorter than one
sign and is never dropped by default; a text that loses all its lines becomes empty; rows that
share an id count as one document and each keep their row; a null id is a document of its own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import free_name

BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
SALTS = 16


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    return F.transform(
        split_lines(lower_ascii(F.coalesce(text, F.lit("")))), lambda line: F.btrim(line, F.lit(BLANKS))
    )


def key_hash(key: Column) -> Column:
    """128 bits of a key; null for keys shorter than the least length."""
    return F.struct(F.xxhash64(key, F.lit(1)).alias("a"), F.xxhash64(key, F.lit(2)).alias("b"))


def frequent_keys_by_document(docs: DataFrame, id_column: str, text: str, least_documents: int, least_signs: int) -> DataFrame:
    """(doc, drop): for each document with some, the hashes of its keys that lose their lines."""
    pairs = (
        docs.select(F.col(id_column).alias("doc"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key"))
        .where(F.char_length("key") >= least_signs)
        .select("doc", F.xxhash64("key", F.lit(1)).alias("a"), F.xxhash64("key", F.lit(2)).alias("b"))
        .distinct()
    )
    frequent = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    frequent = frequent.select("a", "b", salts.alias("salt"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(frequent, ["a", "b", "salt"])
        .groupBy("doc")
        .agg(F.collect_set(F.struct("a", "b")).alias("drop"))
    )


def drop_common_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_documents: int = 10, least_signs: int = 1
) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` reduced, and the number of lines before and dropped.

    The counts are the columns ``lines_before`` and ``lines_dropped``; a column of ``docs``
    with one of these names is replaced.
    """
    drops = frequent_keys_by_document(docs, id_column, text, least_documents, least_signs)
    doc, drop, left = (free_name(docs, n) for n in ("_line_doc", "_line_drop", "_line_kept"))
    drops = drops.select(F.col("doc").alias(doc), F.col("drop").alias(drop))
    joined = docs.join(drops, docs[id_column].eqNullSafe(drops[doc]), "left")
    pairs = F.arrays_zip(
        split_lines(F.col(text)).alias("line"), line_keys(F.col(text)).alias("key")
    )
    kept = F.when(
        F.col(drop).isNull(), split_lines(F.col(text))
    ).otherwise(
        F.transform(
            F.filter(
                pairs,
                lambda p: (F.char_length(p["key"]) < least_signs)
                | ~F.array_contains(F.col(drop), key_hash(p["key"])),
            ),
            lambda p: p["line"],
        )
    )
    names = [c for c in docs.columns if c not in ("lines_before", "lines_dropped")]
    return (
        joined.withColumn(left, kept)
        .withColumn("lines_before", F.size(split_lines(F.col(text))).cast("long"))
        .withColumn("lines_dropped", F.col("lines_before") - F.size(left))
        .withColumn(text, F.array_join(left, "\n"))
        .select(*names, "lines_before", "lines_dropped")
    )


#: The digest of the reduced ``documents`` for DuckDB.
SQL = r"""
with lines as (
  select doc_id, l.pos, l.line,
         translate(trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
               lambda x, i: {'pos': i, 'line': x})) as l from documents)
), frequent as (
  select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10
), marked as (
  select l.*, f.key is not null as gone from lines l left join frequent f on l.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
