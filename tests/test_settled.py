from lodestrata.streaming import settled


def test_files_go_on_once_written_and_again_after_growth(spark, tmp_path):
    folder, listings, out, cp = (str(tmp_path / x) for x in ("in", "listings", "out", "cp"))
    (tmp_path / "in").mkdir()
    tick = start = 1_700_000_000

    def step(**files):
        nonlocal tick
        for name, size in files.items():
            (tmp_path / "in" / f"{name}.md").write_bytes(b"x" * size)
        settled.append_listing(spark, folder, listings, tick)
        tick += 1

    def seen():
        settled.watch(spark, listings, out, cp).awaitTermination()  # each call is a restart
        return sorted((r.file_name, r.bytes, r.tick - start) for r in spark.read.parquet(out).collect())

    step(slow=1, quick=5)
    assert seen() == []
    step(slow=2)
    assert seen() == [("quick.md", 5, 1)]
    step(slow=3)
    step(slow=4)  # two ticks in one batch, still growing
    assert seen() == [("quick.md", 5, 1)]
    step()
    step()
    want = [("quick.md", 5, 1), ("slow.md", 4, 4)]
    assert seen() == want and seen() == want  # nothing new, nothing twice
    settled.append_listing(spark, folder, listings, start + 5)  # a listing again
    assert seen() == want
    tick = start + 6
    step(slow=9)
    assert seen() == want
    step(empty=0)
    step()
    assert seen() == sorted([*want, ("slow.md", 9, 7), ("empty.md", 0, 8)])
