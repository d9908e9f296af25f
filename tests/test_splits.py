"""Readers that carry state over the splits of a file, against whole-file readings."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from panelwright.sources.codebook import SyntaxScan, parse_codebook, read_codebook, read_syntax
from panelwright.sources.files import SNIFF_CHARACTERS, discover, file_heads, route_files
from panelwright.sources.model_output import SelectionScan, parse_selection_texts, read_selections
from panelwright.sources.quoted_csv import quoted_records, running_state
from panelwright.sources.splits import split_lines, split_states, split_summaries
from panelwright.sources.tables import read_csv


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def quoted_file(path, seed, end, rows=150):
    deal = random.Random(seed)
    expected = []
    with open(path, "w", newline="", encoding="cp1252") as file:
        file.write('id,"first, ""note""",second' + end)
        for k in range(rows):
            cells = []
            for _ in range(2):
                text = "".join(deal.choice('ab,"\n é€;') for _ in range(deal.choice([0, 3, 8, 40, 1500 if deal.random() < 0.06 else 5])))
                kind = deal.randint(0, 5)
                if kind < 4:
                    cells.append(('"' + text.replace('"', '""') + '"', text))
                else:
                    plain = "" if kind == 4 else 'x"' + text.replace(",", "").replace("\n", "")
                    cells.append((plain, plain))
            file.write(f"{k}," + ",".join(c[0] for c in cells) + end)
            expected.append((str(k), *(c[1] or None for c in cells)))
    return expected


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_is_cut_inside_its_records(spark, tiny_splits, tmp_path, end):
    for seed in range(3):
        path = tmp_path / f"t{seed}.csv"
        expected = quoted_file(path, seed, end)
        df = read_csv(spark, str(path), infer=False, na_tokens=[""])
        assert df.columns == ["id", 'first, "note"', "second"]
        assert sorted(tuple(r) for r in df.collect()) == sorted(expected)
        assert split_lines(spark, str(path), "\n").rdd.getNumPartitions() > 3
        with open(path, newline="", encoding="cp1252") as file:
            assert quoted_records(spark, str(path)).count() == len(list(csv.reader(file))) - 1


def test_one_record_over_many_splits_and_an_open_end(spark, tiny_splits, tmp_path):
    long = "line\n" * 800
    (tmp_path / "a.csv").write_text(f'"a\n{long}",b\n1,"{long}"\n\n2,x\n3,"open\n{long}')
    found = sorted(bytes(r["record"]).decode() for r in quoted_records(spark, str(tmp_path / "a.csv")).collect())
    assert found == [f'1,"{long}"', "2,x", f'3,"open\n{long}'.rstrip("\n")]
    (tmp_path / "b.csv").write_text("a,b\n")
    assert quoted_records(spark, str(tmp_path / "b.csv")).count() == 0


def test_running_state_is_a_walk():
    import numpy as np

    deal = np.random.default_rng(1)
    for _ in range(50):
        outside, inside = deal.random((2, 30)) < 0.5
        for start in (False, True):
            state, walked = start, []
            for a, b in zip(outside, inside):
                state = bool(b if state else a)
                walked.append(state)
            assert running_state(outside, inside, start).tolist() == walked


def selector_text(seed, blocks=40):
    deal = random.Random(seed)
    parts = ["noise\n", "\n"]
    for _ in range(blocks):
        n = deal.randint(0, 12)
        parts.append(deal.choice(["", "x ", " "]) + "Selected attributes: " + ",".join(str(deal.randint(1, 999)) for _ in range(n)) + f" : {n}\n")
        for _ in range(deal.randint(0, n + 2)):
            parts.append(deal.choice(["   name é%d\n", "plain%d \n", " \n%d\n", "%d\r\n"]) % deal.randint(0, 99))
        parts.append(deal.choice(["\n", "\n\nafter the block\n", "", "\r\n\r\n", "two Selected attributes: 7 Selected attributes: 8\n"]))
    return "".join(parts)


def test_selector_blocks_reach_over_splits(spark, tiny_splits, tmp_path, rows):
    texts = {f"asia_{k}_Wrapper.txt": selector_text(k) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("Selected attributes: 1 : 1\nx\n")
    columns = ("file", "block", "place", "attribute", "attribute_id")
    whole = spark.createDataFrame(list(texts.items()), "file string, text string")
    assert rows(read_selections(spark, str(tmp_path), ["Asia"]), *columns) == rows(parse_selection_texts(whole), *columns)
    lines = split_lines(spark, str(tmp_path / "asia_0_Wrapper.txt"))
    states = split_states(split_summaries(lines, SelectionScan()), SelectionScan())
    assert len(states) > 3 and any(before.open for before, _ in states.values())


def syntax_text(seed):
    deal = random.Random(seed)
    lines = ["* one", 'data list file "c:\\top.txt"'] if seed % 4 == 0 else ["* one", "* two", "DATA LIST FILE", "", "  \"C:\\data\\stu.txt\""] if seed % 2 else ["VALUE", "x 1 - 2 (A)", 'DATA LIST FILE "a\\b.txt"']
    lines += [f"{deal.choice(['', '  ', ' '])}v{k} {k} - {k + 2} (F,{k % 3})" for k in range(30)]
    lines += [f'v{deal.randint(0, 40)} "label é€ {k}"' for k in range(25)]
    lines += [f"Missing values V{deal.randint(0, 40)} ({k},9)." for k in range(10)]
    for _ in range(120):
        lines.append(deal.choice([
            "value labels", "value labels /V1", ".", ". x", f"/V{deal.randint(0, 30)} v{deal.randint(0, 30)}/ y", "//no 3", "",
            *[f"  {deal.randint(0, 9)} \"text {deal.randint(0, 99)}\"" for _ in range(6)]]))
    return deal.choice(["\n", "\r\n"]).join(lines)


def test_syntax_sections_reach_over_splits(spark, tiny_splits, tmp_path, rows):
    for seed in range(8):
        (tmp_path / f"s{seed}.sps").write_bytes(syntax_text(seed).encode("cp1252"))
    split, whole = read_codebook(spark, str(tmp_path)), parse_codebook(read_syntax(spark, str(tmp_path)))
    for mine, theirs, columns in zip(split, whole, (
        ("file", "data_file"), ("file", "name", "start", "end", "fmt", "label"), ("file", "name", "code", "label"), ("file", "name", "code"),
    )):
        assert rows(mine, *columns) == rows(theirs, *columns)
        assert mine.count()
    order = [r["name"] for r in split.variables.filter(F.col("file").endswith("s3.sps")).orderBy("ordinal").collect()]
    assert order == [r["name"] for r in whole.variables.filter(F.col("file").endswith("s3.sps")).orderBy("ordinal").collect()]
    lines = split_lines(spark, str(tmp_path / "s3.sps"))
    states = split_states(split_summaries(lines, SyntaxScan()), SyntaxScan())
    assert len(states) > 4 and any(before.section for before, _ in states.values())


def test_heads_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "sub folder").mkdir()
    (tmp_path / "sub folder" / "é 1%.txt").write_text("x" * (SNIFF_CHARACTERS - 9) + "data list and more")
    (tmp_path / "late.txt").write_text("é" * SNIFF_CHARACTERS + "DATA LIST")
    (tmp_path / "empty.TXT").write_text("")
    with open(tmp_path / "huge.txt", "wb") as file:  # a sparse file beyond what one value can hold
        file.write(b"* VARIABLE LABELS\n")
        file.truncate(5 << 30)
    heads = {r["path"].rsplit("/", 1)[-1]: r["head"] for r in file_heads(discover(spark, str(tmp_path))).collect()}
    assert len(heads) == 3 and heads["late.txt"] == "é" * SNIFF_CHARACTERS  # Spark lists no empty files
    found = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in route_files(spark, str(tmp_path)).collect()}
    assert sorted(found.values()) == ["skip", "syntax", "syntax"] and found["huge.txt"] == "syntax" and found["late.txt"] == "skip"
