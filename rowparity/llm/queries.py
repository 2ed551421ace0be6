"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, jaccard, language, lm, media, packing, passages, secrets, simhash, token_counts, whitening
from .common import new_path, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule set that grew: the base rules over all documents, then all rules, of which the ledger leaves the added ones to scan."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger = secrets.Ledger(spark, new_path(spark))
    for rules in (secrets.BASE, secrets.RULES):
        found = secrets.scan(versions, rules, ledger.pairs())
        ledger.add(found)
    return secrets.digest(secrets.by_path(found.keys, ledger.findings()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_texts(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.both_ways(passages.passages(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(language.training_rows(docs)))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_media_columns": op4_media_columns,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_passages": op7_passages,
    "op8_language_id": op8_language_id,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}


def _secret_sql(rule: secrets.Rule, rank: int) -> str:
    """Rows (doc_id, s, rank, e, kind): the positions follow from the lengths of the parts and of the matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
    select doc_id, s, {rank} as rank, s + n as e, '{rule.kind}' as kind from (
        select doc_id, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) as s, length(ms[i]) as n, length(bs[i]) as b
        from (select doc_id, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as ms, regexp_extract_all(text, '{pattern}', {rule.group}) as bs, unnest(range(1, len(ms) + 1)) as i
              from (select doc_id, coalesce(text, '') as text from documents))
    ) where b >= {rule.least}"""


def _op1_sql() -> str:
    found = " union all ".join(_secret_sql(r, i) for i, r in enumerate(secrets.RULES))
    text = "kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank, e"
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE)
    return f"""
with found as ({found}),
per as (select doc_id, {counts}, string_agg({text}) filter (rank < {len(secrets.BASE)}) as base, string_agg({text}) as spans from found group by doc_id)
select d.doc_id, {zero}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per on d.doc_id = per.doc_id"""


def _op9_sql() -> str:
    """Every backslash and every control string of a text takes one more character in the output."""
    size = lambda x: f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + " + " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL) + ")"
    block = len(chat.OPEN + chat.BODY + chat.STOP + chat.CLOSE)
    return f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked as (select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) = role, false) as goes_on from turns)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum({size("text")} + case when goes_on then {len(chat.NEXT)} else {block} + {size("role")} end)::bigint as formatted_chars
from marked group by conv_id"""


def _op12_sql() -> str:
    """Whole numbers of 128 bits throughout."""
    share = lambda n, total: f"(1 + {divergence.UNIT}::hugeint * ({n} + {divergence.PRIOR}) // ({total} + {divergence.PRIOR}::hugeint * v))"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with docs as (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
    from documents
),
said as (select d, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as total from said group by lang, term having count(distinct d) >= 30),
langs as (select lang, count(*) as v, sum(total) as lang_total from kept group by lang),
own as (select lang, source, term, count(*) as n from said semi join kept using (lang, term) group by lang, source, term),
groups as (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total, coalesce(own_total, 0) as own_total
    from (select distinct lang, source from docs) g left join langs using (lang)
        left join (select lang, source, sum(n) as own_total from own group by lang, source) using (lang, source)
),
dense as (
    select g.lang, g.source, k.term, coalesce(n, 0) as n, {share("coalesce(n, 0)", "own_total")} as p, {share("total", "lang_total")} as q
    from groups g join kept k using (lang) left join own using (lang, source, term)
),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from dense x join dense y using (lang, term) where x.source <> y.source group by all) f
            on f.lang = a.lang and f.source = a.source and f.item = b.source
),
found as (
    select lang, source, 'pair' as part, item, value from pairs
    union all select lang, source, 'term', term, (p - q)::bigint from dense where n > 0 and p > q
),
placed as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select * from placed where part = 'pair' or rank <= 50"""


ORACLE_SQL: dict[str, str] = {"op1_secret_scans": _op1_sql(), "op9_chat_formatting": _op9_sql(), "op12_source_divergence": _op12_sql()}
