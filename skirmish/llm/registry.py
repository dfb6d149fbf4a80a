"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import audio, chunks, codes, importance, langid, lines, mixing, neighbours, packing, quality, simhash, suffixes, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_lines": lines.op2_lines,
    "op3_quality": quality.op3_quality,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_warc": warc.op5_warc,
    "op6_audio": audio.op6_audio,
    "op7_mixing": mixing.op7_mixing,
    "op8_chunks": chunks.op8_chunks,
    "op9_simhash": simhash.op9_simhash,
    "op10_langid": langid.op10_langid,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_importance": importance.op12_importance,
    "op13_codes": codes.op13_codes,
}

ORACLES: dict[str, str] = {"op7_mixing": mixing.OP7_SQL, "op12_importance": importance.OP12_SQL, "op13_codes": codes.OP13_SQL}
