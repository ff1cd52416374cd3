"""Line deduplication over a corpus, with DataFrame functions only.

1. Explode. Each text is split at line feeds. A line's key is the line without white space at both ends and with A-Z
   in lower case; keys of fewer than ``min_chars`` code points are left alone.
2. Hash and count. Keys become 32-byte hashes; the different documents that hold each hash are counted, first by
   (hash, document), so that a line which a third of the corpus shares is spread over all tasks, then by hash.
3. Drop. Hashes of at least ``min_docs`` documents meet the lines again, and their places are gathered for each text.
   All lines of such a key go, but those in the largest document id that holds it.
4. Reassemble. The runs of lines between dropped places are joined again in order.

A null text is empty: one empty line. Documents are told apart by id; rows that share an id are one document when
counting, but each is cut for itself and equal rows come out alike. Rows with a null id are one document, which comes before
all others. Very long texts are one row each; a text's lines and places are bounded by the text. Other columns are kept,
but for those that the operator adds, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from skytile.session import free_prefix

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"


def _digest(text: Column) -> Column:
    """SHA-256 as 32 bytes; never null, so that joins need no test for it."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def line_key(bare: Column) -> Column:
    """The bare line with A-Z in lower case."""
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() is much faster, but changes other letters, too
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: document, hash of its text, place from 0, hash of the key."""
    rows = docs.where(F.char_length(text_col) >= min_chars).select(F.col(id_col).alias("doc"), _digest(F.col(text_col)).alias("row"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    bare = F.btrim("line", F.lit(SPACE))
    return rows.where(F.char_length(bare) >= min_chars).select("doc", "row", "pos", _digest(line_key(bare)).alias("hash"))


def frequent_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hash, docs, kept_id) of keys that at least ``min_docs`` documents hold; the largest id keeps its lines."""
    pairs = lines.groupBy("hash", "doc").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("hash").agg(F.count("one").alias("docs"), F.max("doc").alias("kept_id"))
    return counted.where(F.col("docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays in place of the old one, ``n_lines`` before dropping and ``n_dropped``."""
    lines = long_lines(docs, min_chars, id_col, text_col)
    keys = frequent_keys(lines, min_docs)
    elsewhere = ~F.col("doc").eqNullSafe(F.col("kept_id"))
    places = lines.join(keys.select("hash", "kept_id"), "hash").where(elsewhere).groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    p = free_prefix(docs, start="line")
    places = places.select(F.col("doc").alias(f"{p}doc"), F.col("row").alias(f"{p}row"), F.col("places").alias(f"{p}places"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.withColumns({f"{p}own_doc": F.col(id_col), f"{p}own_row": _digest(text)})
    met = met.join(places, F.col(f"{p}own_doc").eqNullSafe(F.col(f"{p}doc")) & (F.col(f"{p}own_row") == F.col(f"{p}row")), "left")
    met = met.withColumn(f"{p}all", F.split(text, "\n", -1))
    # The runs between dropped places; the bounds before the first and after the last line close them.
    met = met.withColumn(f"{p}bounds", F.concat(F.array(F.lit(-1)), F.col(f"{p}places"), F.array(F.size(f"{p}all"))))
    at = lambda i: F.get(f"{p}bounds", i)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(f"{p}places")), lambda i: F.slice(f"{p}all", at(i) + 2, at(i + 1) - at(i) - 1)))
    whole = F.col(f"{p}places").isNull()
    new = {
        text_col: F.when(whole, F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(f"{p}all").cast("long"),
        "n_dropped": F.when(whole, F.lit(0)).otherwise(F.size(f"{p}places")).cast("long"),
    }
    held = [F.col(c) for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    return met.select(*held, *[c.alias(n) for n, c in new.items()])


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = f"""
with lines as (
  select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)
), frequent as (
  select key, max(doc_id) as kept_id from lines where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}
), marked as (
  select l.*, f.key is not null and f.kept_id <> l.doc_id as gone from lines l left join frequent f on f.key = l.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""
