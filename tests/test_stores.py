from loamdex.operators.keyword import fts_search
from loamdex.operators.stores import ChunkTable
from loamdex.operators.vector import CellIndex

CHUNK = "uri string, chunk_index int, text string, title string, vector array<float>"


def test_a_table_is_a_store_of_both_kinds(spark, tmp_path):
    store = ChunkTable(spark.createDataFrame([("a", 0, "payment cards", None, [1.0, 0.0]), (None, 0, "lost payment", None, None)], CHUNK))
    more = store.insert(spark.createDataFrame([("b", 0, "payment pool", None, [0.0, 1.0])] * 2, CHUNK))
    assert (store.count(), more.count()) == (2, 4)
    assert [r["uri"] for r in more.search("pool").collect()] == ["b", "b"] and more.near([0.0, 2.0], 1).collect()[0]["uri"] == "b"
    # Frequencies follow the rows: the term is rarer once rows are gone.
    left, n = more.delete("b")
    assert n == 2 and left.count() == 2 and left.delete("none")[1] == 0 and left.search("pool").count() == 0
    assert left.search("cards").collect()[0]["score"] < more.search("cards").collect()[0]["score"]
    assert more.both("pool", [1.0, 0.0], 1, "vector_only").collect()[0]["uri"] == "a"
    seen = []
    assert more.push("payment", 3, lambda r: (seen.append(r["uri"]), len(seen) < 2)[1]) == 2 and len(seen) == 2
    assert more.push("nothing", 3, lambda r: True) == 0
    more.save(str(tmp_path / "t"))
    again = ChunkTable.load(spark, str(tmp_path / "t"), fts_search)
    assert again.count() == 4 and len(list(again.export())) == 4 and again.search("pool").count() == 2


def test_an_index_of_cells_is_kept_in_a_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", 0, "", None, [float(i % 7), float(i % 3), 1.0]) for i in range(40)], CHUNK)
    index = CellIndex.fit(rows)
    index.save(str(tmp_path / "cells.npy"))
    again = CellIndex.load(str(tmp_path / "cells.npy"))
    q = [6.0, 2.0, 1.0]
    assert again.search(again.assign(rows), q, 3, probes=40).collect() == index.search(index.assign(rows), q, 3, probes=40).collect()
