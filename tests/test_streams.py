from caseweave.plans import queries


def test_dialogue_reads_a_folder_of_files_in_any_order(spark, tmp_path):
    rows = [(c, t, "user", text) for c in range(4) for t, text in enumerate(["see Abcdefghijk at 12", "and then", None, "Zyxwvutsrqp", "34 of them", ""])]
    frame = "conv_id long, turn long, role string, text string"
    # the files with the later turns are written first
    for part in range(3, -1, -1):
        own = [r for k, r in enumerate(rows) if (k * 7 + r[1]) % 4 == part]
        spark.createDataFrame(own, frame).coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.conv_id, r.turn): (r.prev_person, r.prev_place) for r in queries()["sm1_dialogue_context"](spark, str(tmp_path)).collect()}
    carried = [(None, None), ("Abcdefghijk", "12"), ("Abcdefghijk", "12"), ("Abcdefghijk", "12"), ("Zyxwvutsrqp", "12"), ("Zyxwvutsrqp", "34")]
    assert found == {(c, t): carried[t] for c in range(4) for t in range(6)}
