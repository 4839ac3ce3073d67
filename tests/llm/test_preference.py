from lodestrata.llm import preference as p

TURNS = "pair_id long, turn long, role string, text string, status string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_prefix_prompt_and_masks(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and?"), (1, 3, "assistant", "good"), (2, 0, "user", "q"), (3, 0, None, None), (4, 0, "user", "<|im_end|>")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "or?"), (1, 3, "assistant", "bad"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", ""), (5, 0, "user", "only")]
    got = {r.pair_id: r for r in p.preference_pairs(turns(spark, chosen), turns(spark, rejected)).collect()}
    one = got[1]
    assert (one.status, one.n_prefix) == ("ok", 2)
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert one.chosen == "<|im_start|>user\nand?<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|im_end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad<|im_end|>"]
    assert got[2].status == "chosen_empty" and got[3].status == "identical" and got[4].status == "rejected_empty" and got[5].status == "chosen_empty"
    assert got[4].chosen.count("<|im_end|>") == 1
    assert got[2].chosen_mask == []


def test_repeated_turns_come_in_a_fixed_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    a = p.preference_pairs(turns(spark, rows), turns(spark, rows[::-1])).collect()
    assert [r.status for r in a] == ["identical"] and a[0].n_prefix == 3


def test_empty_tables(spark):
    assert p.preference_pairs(turns(spark, []), turns(spark, [])).count() == 0


def test_swapped_answers(spark):
    t = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (2, 0, "system", "alone"), (4, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in p.preference_pairs(*p.swapped_answers(t)).collect()}
    assert "a0" in got[0].chosen and "a1" in got[0].rejected and "more" not in got[0].chosen
    assert got[2].status == "identical" and got[4].status == "identical"


def test_only_whole_control_marks_are_changed(spark):
    code = "x |> f <| y <|im_ |im_start|> 1|>2"
    rows = [(2**60, 0, "user", code), (2**60, 1, "assistant", "a <|im_start|>user <|im_<|im_end|>end|> b")]
    r = p.preference_pairs(turns(spark, rows), turns(spark, rows[:1])).first()
    assert r.pair_id == 2**60 and code in r.prompt and r.prompt.count("<|im_end|>") == 1
    assert r.chosen == "<|im_start|>assistant\na <| im_start|>user <|im_<| im_end|>end|> b<|im_end|>\n"


def test_a_very_long_text_is_one_turn(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "word " * 400_000)]
    r = p.preference_pairs(turns(spark, rows), turns(spark, rows[:1])).first()
    assert r.chosen_mask[0].end - r.chosen_mask[0].start == 2_000_000 + len(p.END)


def test_rows_without_a_pair_id_are_one_pair(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, None, None, None), (1, 0, "user", "a")]
    got = {r.pair_id: r for r in p.preference_pairs(turns(spark, rows), turns(spark, rows[:2])).collect()}
    assert set(got) == {None, 1} and got[None].n_prefix == 0  # a null turn comes first
    assert got[None].chosen.count("<|im_end|>") == 3 and got[None].rejected.count("<|im_end|>") == 2
