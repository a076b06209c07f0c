"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from docquarry.llm.chat import OP7_SQL, op7_chat_formatting
from docquarry.llm.decontaminate import OP8_SQL, op8_decontamination
from docquarry.llm.embeddings import OP2_SQL, op2_embedding_dedup
from docquarry.llm.langid import op10_language_id
from docquarry.llm.linededup import OP4_SQL, op4_line_dedup
from docquarry.llm.mixing import OP5_SQL, op5_mixing
from docquarry.llm.quality import op9_quality
from docquarry.llm.secrets import OP3_SQL, op3_secrets
from docquarry.llm.simhash import op1_simhash
from docquarry.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secrets": op3_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": OP2_SQL,
    "op3_secrets": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_decontamination": OP8_SQL,
}
