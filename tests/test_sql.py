"""The SQL surface: views and table functions in plain SQL texts."""

from seqloom.sql import register


def test_views_and_functions(spark):
    seqs = spark.createDataFrame([(1, "a", "abab"), (2, "b", ""), (3, "c", "xé\U0001f600ab"), (4, "d", None)], "seq_id int, name string, seq string")
    pats = spark.createDataFrame([(1, "ab"), (2, "zab"), (3, ""), (4, None), (5, "ab")], "read_id int, pattern string")
    register(spark, seqs, pats, "t_", suffixes=True)
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    hits = [(1, 0), (1, 2), (3, 3)]
    assert rows("SELECT * FROM t_pattern_hits") == [(r, *h) for r in (1, 5) for h in hits]
    assert rows("SELECT * FROM t_pattern_counts") == [(1, 3), (2, 0), (3, 0), (4, 0), (5, 3)]
    assert rows("SELECT * FROM t_pattern_suffixes") == [(1, 2, 3), (2, 2, 3), (5, 2, 3)]
    assert rows("SELECT * FROM t_sequence_index") == [(1, "a", 0, 4), (2, "b", 4, 0), (3, "c", 4, 5)]
    assert rows("SELECT * FROM t_locate(TABLE(t_sequences), 'ab')") == [(str(a), b) for a, b in hits]
    assert rows("SELECT * FROM t_locate(TABLE(t_sequences), '')") == []
    assert rows("SELECT * FROM t_sequence_at(4)") == [(3, "c", 0)] and rows("SELECT * FROM t_sequence_at(9)") == []
    assert rows("SELECT name, count(*) FROM t_pattern_hits JOIN t_sequence_index USING (seq_id) GROUP BY name") == [("a", 4), ("c", 2)]


def test_empty_tables(spark):
    register(spark, spark.createDataFrame([], "seq_id int, name string, seq string"), spark.createDataFrame([], "read_id int, pattern string"), "e_", suffixes=True)
    for v in ("pattern_hits", "pattern_counts", "pattern_suffixes", "sequence_index"):
        assert spark.sql(f"SELECT * FROM e_{v}").collect() == []
