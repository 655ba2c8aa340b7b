"""Queries of the text problems; imported by the driver entry only where this subpackage exists."""

from countflow.llm import mixing, packing, sentences

QUERIES = {
    "p7_containers": packing.p7_containers,
    "p7_report": packing.p7_report,
    "p7_by_characters": packing.p7_by_characters,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p8_by_characters": mixing.p8_by_characters,
    "p9_found": sentences.p9_found,
}

SQL: dict[str, str] = {"p7_by_characters": packing.BY_CHARACTERS, "p8_by_characters": mixing.BY_CHARACTERS}
