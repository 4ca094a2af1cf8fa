"""op4: all `conversations`, and conversation -7, formatted and read back."""

from pyspark.sql import functions as F

from .chat_format import conversation_digests, format_turns, text_parts
from .common import table

NAME = "op4_chat_format"


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    turns = rows.unionByName(odd).select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return conversation_digests(format_turns(turns)).drop("expanded_tokens")


#: formatted_chars: each turn has 23 characters of marks, and a backslash for each backslash and control string.
SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(23 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|<\|turn\|>|<\|says\|>|<\|end\|>|<\|image\|>|<\|audio\|>|<\|document\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
