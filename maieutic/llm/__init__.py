"""Operators of a large-scale training-data pipeline.

url_rules          op1   reversed-host interval sweep over URL rules
token_count        op2   whole-token shortcut token counts
line_dedup         op3   segment-partition edit join of lines
quality_rules      op4   suffix-array repetition limits
paragraph_dedup    op5   paragraph banding, verification, clustering
substring_dedup    op6   run-length index over repeated byte strings
mixing             op7   capped water-filling and seeded repetitions
near_dup           op8   SetSketch banding, likelihood estimate, verification
decontaminate      op9   prefix-filtered set join with benchmark windows
binary_records     op10  framed token-id records and their offset index

Every operator reads only the columns it names, so further columns of its
input (whatever they are called) neither disturb it nor pass through it.
"""
