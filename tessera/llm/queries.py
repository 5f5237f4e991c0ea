"""The queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import audio, bpe, chat, decontaminate, lines, minhash, ppm, secrets, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_shard": sharding.op2_shard,
    "op3_leaks": decontaminate.op3_leaks,
    "op4_ppm": ppm.op4_ppm,
    "op5_audio": audio.op5_audio,
    "op6_lines": lines.op6_lines,
    "op7_secrets": secrets.op7_secrets,
    "op8_chat": chat.op8_chat,
    "op9_near": minhash.op9_near,
    "op10_bpe": bpe.op10_bpe,
}
SQL = {"op3_leaks": decontaminate.OP3_SQL, "op8_chat": chat.OP8_SQL}
