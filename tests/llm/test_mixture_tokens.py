"""The contents of the whole mixture, as a registered query."""

from pyspark.sql import functions as F

from shutterstack.llm.queries import QUERIES


def test_every_block_has_its_tokens(spark, sample):
    mixed, tokens = (QUERIES[name](spark, sample).persist() for name in ("p8_mixture", "p8_tokens"))
    both = mixed.join(tokens, ["shard_no", "slot_no"])
    assert mixed.count() == tokens.count() == both.where(F.size("tokens") == F.col("n_tokens")).count() > 0
