"""The subpackage's queries for the driver contract."""

from __future__ import annotations

from voxelweave.llm.ann import op2_ann
from voxelweave.llm.chat import op9_chat
from voxelweave.llm.fingerprints import ORACLE as FINGERPRINTS_SQL
from voxelweave.llm.fingerprints import op12_fingerprints
from voxelweave.llm.merkle import op11_merkle
from voxelweave.llm.merkle import oracle as merkle_sql
from voxelweave.llm.near_dedup import op10_near_dedup
from voxelweave.llm.packing import op3_packing
from voxelweave.llm.quality_rules import op7_quality_rules
from voxelweave.llm.sharding import op8_sharding
from voxelweave.llm.site_quality import op1_site_quality
from voxelweave.llm.spelling import ORACLE as SPELLING_SQL
from voxelweave.llm.spelling import op13_spelling
from voxelweave.llm.token_files import op5_token_files
from voxelweave.llm.toxicity import op4_toxicity
from voxelweave.llm.unigram import op6_unigram


def queries() -> dict:
    return {"op1_site_quality": op1_site_quality, "op2_ann": op2_ann, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_token_files": op5_token_files, "op6_unigram": op6_unigram, "op7_quality_rules": op7_quality_rules, "op8_sharding": op8_sharding, "op9_chat": op9_chat, "op10_near_dedup": op10_near_dedup, "op11_merkle": op11_merkle, "op12_fingerprints": op12_fingerprints, "op13_spelling": op13_spelling}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": merkle_sql(), "op12_fingerprints": FINGERPRINTS_SQL, "op13_spelling": SPELLING_SQL}
