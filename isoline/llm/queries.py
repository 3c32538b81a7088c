"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_ann
from .bpe import op5_bpe
from .chat import OP8_SQL, op8_chat_format
from .html_extract import op7_html_extract
from .jaccard import OP13_SQL, op13_ngram_jaccard
from .langid import op9_language_id
from .mixing import op1_mixing
from .mpegts import op6_mpeg_ts
from .ranked import OP12_SQL, op12_ranked_search
from .secrets import op3_secret_scan
from .simhash import op4_simhash
from .toxicity import op10_toxicity
from .trie import OP11_SQL, op11_conversation_trie

ALL = (op1_mixing, op2_ann, op3_secret_scan, op4_simhash, op5_bpe, op6_mpeg_ts, op7_html_extract, op8_chat_format, op9_language_id, op10_toxicity, op11_conversation_trie, op12_ranked_search, op13_ngram_jaccard)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": OP8_SQL, "op11_conversation_trie": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_ngram_jaccard": OP13_SQL}
