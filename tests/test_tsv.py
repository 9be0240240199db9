import os

from babelcask.sources import tsv
from babelcask.sources.tables import clean_corpus

ROWS = (
    "text\tlabel\tlanguage\n"
    '"a ""q"" b"\tpositive\tam\n'
    '"two\nlines"\tnegative\tam\n'
    '"tab\there"\tneutral\tam\n'
    "back\\slash\tpositive\tam\n"
    " lead \tpositive\tam\n"
    "NA\tpositive\tam\n"
    "None\tnegative\tam\n"
    "\tneutral\tam\n"
    '"""NA"""\tpositive\tam\n'
    "ibo\n"
    "id1\thello\tpositive\tam\n"
)


def _write(scratch, name, content):
    p = os.path.join(scratch, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_quotes_newlines_tabs_and_rejects(spark, scratch):
    p = _write(scratch, "am_train.tsv", ROWS)
    ok, bad = tsv.split_rejects(tsv.read_tsv(spark, p))
    texts = [r["text"] for r in ok.collect()]
    assert 'a "q" b' in texts
    assert "two\nlines" in texts
    assert "tab\there" in texts
    assert "back\\slash" in texts
    assert " lead " in texts
    assert '"NA"' in texts
    # a field too many or too few: rejected whole, not shifted and not padded
    assert sorted((r["n_fields"], r["expected"], r["record"]) for r in bad.collect()) == [
        (1, 3, "ibo"), (4, 3, "id1\thello\tpositive\tam")]


def test_width_is_judged_on_the_record(spark, scratch):
    wide = ["gap\tpositive\tam\t\tLOST", "empty\tpositive\tam\t", "three\tpositive\tam\ta\tb\tc",
            '"q\nt\t""x"""\tpositive\tam\t""', '"' + 'a\t""' * 50_000 + '"\tpositive\tam\tx', '5" tall\tpositive\tam\tx', '"t"\t"a\tb"']
    widths = [5, 4, 6, 4, 4, 4, 2]
    fine = ['5" ok\tpositive\tam', '"a\tb"\tpositive\tam']
    p = _write(scratch, "am_train.tsv", "\n".join(["text\tlabel\tlanguage", *wide, *fine]) + "\n")
    ok, bad = tsv.split_rejects(tsv.read_tsv(spark, p))
    assert sorted((r["record"], r["n_fields"]) for r in bad.collect()) == sorted(zip(wide, widths, strict=True))
    assert sorted(r["text"] for r in ok.collect()) == ['5" ok', "a\tb"]
    # the same verdicts whatever columns a plan reads
    assert (ok.select("language").count(), ok.count(), bad.count(), bad.select("file").distinct().count()) == (2, 2, 7, 1)
    counts = {(r["n_fields"], r["n"]) for r in tsv.reject_counts(bad).collect()}
    assert counts == {(5, 1), (4, 4), (6, 1), (2, 1)}


def test_language_codes_come_back_as_written(spark, scratch):
    codes = ["pt:br", "01", "a b", "a+b", "x%41", "1e5", "true"]
    df = spark.createDataFrame([(str(i), f"t{i}", c) for i, c in enumerate(codes)], "doc_id string, text string, language string")
    tsv.write_tsv(df, f"{scratch}/parts", partition_by="language")
    ok, bad = tsv.read_language_files(spark, f"{scratch}/parts", ("doc_id", "text"), partition="language")
    assert sorted(tuple(r) for r in ok.collect()) == sorted(tuple(r) for r in df.collect())
    assert bad.count() == 0
    names = [c for c in codes if ":" not in c]         # a colon cannot stand in a file's name here
    for c in names:
        _write(scratch, f"{c}_train.tsv", f"text\tlabel\n{c}\tpositive\nlong\tpositive\tx\n")
    ok, bad = tsv.read_language_files(spark, f"{scratch}/*_train.tsv")
    assert sorted((r["text"], r["language"]) for r in ok.collect()) == sorted(zip(names, names, strict=True))
    assert bad.count() == len(names)


def test_files_are_bound_in_bytes(spark, scratch):
    df = spark.createDataFrame([(str(i), "x" * 1000) for i in range(400)], "doc_id string, text string").coalesce(1)
    tsv.write_tsv(df, f"{scratch}/cut", file_bytes=100_000)
    sizes = [os.path.getsize(f"{scratch}/cut/{f}") for f in os.listdir(f"{scratch}/cut") if f.startswith("part")]
    assert len(sizes) >= 4 and max(sizes) < 130_000
    assert tsv.split_rejects(tsv.read_tsv(spark, f"{scratch}/cut", columns=("doc_id", "text")))[0].count() == 400


def test_null_tokens_dropped(spark, scratch):
    p = _write(scratch, "am_train.tsv", ROWS)
    ok, _ = tsv.split_rejects(tsv.read_tsv(spark, p))
    clean = [r["text"] for r in clean_corpus(ok).collect()]
    assert "NA" not in clean and "None" not in clean and "" not in clean
    assert '"NA"' in clean
    assert len(clean) == 6


def test_language_from_file_name_and_union(spark, scratch):
    _write(scratch, "am_train_with_lang.tsv", "text\tlabel\nselam\tpositive\n")
    _write(scratch, "ibo_train_with_lang.tsv", "text\tlabel\nndewo\tnegative\nndewo\tnegative\n")
    df, bad = tsv.read_language_files(spark, os.path.join(scratch, "*_train_with_lang.tsv"))
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("ndewo", "negative", "ibo"), ("ndewo", "negative", "ibo"), ("selam", "positive", "am")]
    assert bad.count() == 0
    frames = [tsv.read_language_files(spark, os.path.join(scratch, f"{l}_train_with_lang.tsv"), language=l)[0]
              for l in ("am", "ibo")]
    assert tsv.positional_union(frames).count() == 3


def test_write_read_roundtrip(spark, scratch):
    rows = [("1", 'x "y"\tz\nw', "am"), ("2", " lead", "ibo"), ("3", "", "am")]
    df = spark.createDataFrame(rows, "doc_id string, text string, language string")
    out = os.path.join(scratch, "out")
    tsv.write_tsv(df, out, partition_by="language")
    back, _ = tsv.split_rejects(tsv.read_tsv(spark, out, columns=("doc_id", "text"), partition="language"))
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "language").collect()) == sorted(rows)


def test_single_line_read_equals_multi_line_without_breaks(spark, scratch):
    df = spark.createDataFrame([(str(i), f'text {i} with "q"', "positive") for i in range(50)],
                               "doc_id string, text string, label string")
    tsv.write_tsv(df, f"{scratch}/flat")
    a = tsv.read_tsv(spark, f"{scratch}/flat", columns=("doc_id", "text", "label"))
    b = tsv.read_tsv(spark, f"{scratch}/flat", columns=("doc_id", "text", "label"), multi_line=False)
    assert sorted(tuple(r)[:4] for r in a.collect()) == sorted(tuple(r)[:4] for r in b.collect())
    assert a.count() == b.count() == 50
