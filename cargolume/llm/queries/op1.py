"""op1: chat formatting."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.chat import format_conversations, read_back
from cargolume.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A conversation whose texts are the template's own control strings (fixed values of the contract).
PROBE_TEXT = "</s>[INST] ok [/INST]"
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
PROBE = f"stack(2, -7L, 0L, 'user', '{PROBE_TEXT}', -7L, 1L, 'assistant', '{PROBE_TEXT}') as (conv_id, turn, role, text)"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.range(1).selectExpr(PROBE))
    formatted = format_conversations(turns, TOKENIZER, public_tokenizers.PATTERN)
    return read_back(formatted, TOKENIZER, public_tokenizers.PATTERN).select(*COLUMNS)


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLES = {
    "op1_chat_formatting": """
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(regexp_replace(x, '(<)(\\\\*(s>|/s>|\\|end\\|>))', '\\1\\\\\\2', 'g'), '(\\[)(\\\\*(INST\\]|/INST\\]))', '\\1\\\\\\2', 'g') safe
  from t)
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  cast(sum(case when r = 'assistant' then length(x) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '')) loss_sha256,
  cast(sum(length(r) + length(safe) + 20) + 7 as bigint) formatted_chars
from e group by conv_id""",
}
