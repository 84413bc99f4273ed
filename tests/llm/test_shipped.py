"""Tasks of the training-data operators in workers that find only what was shipped."""

import os

from test_shipping import run_elsewhere

#: After packing ran, some worker still has the encoder of that earlier job.
_AGAIN = """
from ranklake.llm import packing
def kept(batches):
    for b in batches:
        if packing._encoders:
            yield b
assert spark.range(0, 16, 1, 8).mapInArrow(kept, "id long").count() > 0, "the word cache of an earlier task is gone"
"""


def test_operators_run_elsewhere(tmp_path):
    names = ["op2_chat_format", "op3_spotsigs", "op6_quality", "op7_language", "op10_license_scan", "op9_packing"]
    run_elsewhere(tmp_path, names, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), _AGAIN)
