"""Registered queries of this subpackage: opN_<name> and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load
from tessera.llm import decontaminate as _leaks
from tessera.llm import extract as _extract
from tessera.llm import flac as _flac
from tessera.llm import language as _language
from tessera.llm import lines as _lines
from tessera.llm import minhash as _minhash
from tessera.llm import packing as _packing
from tessera.llm import substrings as _substrings
from tessera.llm import toxicity as _toxicity
from tessera.llm import warc as _warc


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract.extract(load(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    folder = _warc.new_folder(pages)
    return _warc.read_records(_warc.write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id")


def toxicity_model(spark: SparkSession, sf_dir: str) -> _toxicity.Model:
    """The model learned from the labelled documents outside the held-out fold."""
    rows = _toxicity.sample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), _toxicity.remainder("doc_id") == 1)
    return _toxicity.train([t for t, _ in rows], [y for _, y in rows])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _toxicity.score(load(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (_toxicity.remainder("doc_id") == 1).alias("held_out"), "score", "predicted")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substrings.dedup(load(spark, sf_dir, "documents"), keep_text=False)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _lines.dedup(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    """Where the public vocabulary file is; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = _language.remainder("doc_id", 5) == 0
    rows = _language.sample(docs, "text", "lang", ~held_out, "doc_id")
    model = _language.train([t for t, _ in rows], [lang for _, lang in rows])
    found = _language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return _flac.digest(_flac.write_media(docs, _flac.new_folder(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_toxicity": op2_toxicity, "op3_substrings": op3_substrings, "op4_lines": op4_lines, "op5_packing": op5_packing, "op6_language": op6_language, "op7_extract": op7_extract, "op8_warc": op8_warc, "op9_decontaminate": op9_decontaminate, "op10_media": op10_media}


#: Windows of 20 words by their text, in the order of their starts; a later equal one takes its words away.
SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: Distinct lines by first place; at most one edit apart means an equal half and a remainder with one character replaced or added.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
f AS (SELECT line, length(line) AS n, min(doc_id * 10000000 + pos) AS place FROM l WHERE length(trim(line)) >= 20 GROUP BY line),
c AS (
  SELECT a.line AS x, b.line AS y, greatest(a.place, b.place) AS late FROM f a JOIN f b ON a.n = b.n AND left(a.line, CAST(a.n // 2 AS INT)) = left(b.line, CAST(b.n // 2 AS INT)) AND a.place < b.place
  UNION SELECT a.line, b.line, greatest(a.place, b.place) FROM f a JOIN f b ON a.n = b.n AND right(a.line, CAST(a.n - a.n // 2 AS INT)) = right(b.line, CAST(b.n - b.n // 2 AS INT)) AND a.place < b.place
  UNION SELECT a.line, b.line, greatest(a.place, b.place) FROM f a JOIN f b ON a.n + 1 = b.n AND left(a.line, CAST(a.n // 2 AS INT)) = left(b.line, CAST((b.n - 1) // 2 AS INT))
  UNION SELECT a.line, b.line, greatest(a.place, b.place) FROM f a JOIN f b ON a.n + 1 = b.n AND right(a.line, CAST(a.n - a.n // 2 AS INT)) = right(b.line, CAST(b.n - 1 - (b.n - 1) // 2 AS INT))),
p AS (SELECT late, string_split(x, '') AS x, string_split(y, '') AS y FROM c),
q AS (SELECT late, x, y, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS head FROM p),
late AS (SELECT DISTINCT late FROM q WHERE x[head+2:] = y[head+2:] OR x[head+1:] = y[head+2:]),
stays AS (SELECT place FROM f ANTI JOIN late ON f.place = late.late)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM (SELECT l.*, length(trim(line)) < 20 OR place IS NOT NULL AS keep FROM l LEFT JOIN stays ON place = doc_id * 10000000 + pos) GROUP BY doc_id
"""


#: SHA-1 in base32: each character is five bits, cut out of two hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, list_transform(range(40), lambda k: instr('0123456789abcdef', substr(h, CAST(k + 1 AS INT), 1)) - 1) AS d FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((d[5 * i // 4 + 1] * 16 + d[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": SUBSTRINGS_SQL, "op4_lines": LINES_SQL, "op8_warc": WARC_SQL}
