import random

import pytest
from pyspark.sql import functions as F

from reportloom.functions import hl7
from reportloom.operators import curate
from reportloom.sources import logs
from reportloom.sources.messages import parse_messages, read_hl7


def parse(spark, content):
    row = parse_messages(spark.createDataFrame([(content,)], "content string")).first()
    return row["message"], [(s["id"], list(s["fields"])) for s in row["segments"]]


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
def test_line_ends(spark, end):
    message, segments = parse(spark, end.join(["MSH|a", "PID|1||x", "", "OBX|2"]))
    assert message == "MSH|a"
    assert segments == [("PID", ["1", "", "x"]), ("OBX", ["2"])]


def test_edge_lines(spark):
    assert parse(spark, "\rPID|1|||\r|||\rZZZ") == ("", [("PID", ["1"]), ("", []), ("ZZZ", [])])
    assert parse(spark, "MSH|é÷") == ("MSH|é÷", [])


def test_files(spark, tmp_path):
    (tmp_path / "a.hl7").write_bytes("MSH|ü\rPID|1\r".encode())
    (tmp_path / "empty.hl7").write_bytes(b"")
    rows = read_hl7(spark, str(tmp_path)).collect()
    assert [(r["message"], r["source_file"].rsplit("/", 1)[1]) for r in rows] == [("MSH|ü", "a.hl7")]


def test_dates(spark):
    values = ["20240229", "20230229", "19991301", "", None, "20240102extra", "202401021530", "20240102153059",
              "2024010215305", "20240102153059-0600"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(
        hl7.parse_hl7_date("v").cast("string").alias("d"), hl7.parse_hl7_ts("v").cast("string").alias("t")
    )
    rows = [(r["d"], r["t"]) for r in df.collect()]
    assert [d for d, _ in rows] == [
        "2024-02-29", None, None, None, None, "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02"
    ]
    assert [t for _, t in rows] == [None] * 6 + ["2024-01-02 15:30:00", "2024-01-02 15:30:59", None, None]


def test_no_observations_gives_null_text(spark):
    df = parse_messages(spark.createDataFrame([("MSH|a\rPID|1",)], "content string"))
    row = df.select(
        hl7.assemble_text(hl7.segments("OBX")).alias("t"),
        hl7.section(hl7.segments("OBX"), ["IMP"]).alias("s"),
        F.size(hl7.diagnoses(hl7.segments("DG1"))).alias("n"),
    ).first()
    assert tuple(row) == (None, None, 0)


def split_by_hand(lines):
    """The state machine over the lines of one file."""
    found, current = [], None
    for line in lines:
        if current is None:
            if "<SB>" in line:
                current = []
            continue
        kept = line[:-3] if line.endswith("<R>") else line
        current.append(kept.replace("<EB>", ""))
        if "<EB>" in line:
            found.append(current)
            current = None
    if current is not None:
        found.append(current)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_frames_do_not_depend_on_blocks(spark, seed):
    rng = random.Random(seed)
    pieces = ["MSH|1<R>", "text", "", "<SB>", "<EB>", "x<EB>y<R>", "<SB><EB>", "a<SB>b", "<R>"]
    rows, expected = [], {}
    for f in range(5):
        lines = [rng.choice(pieces) for _ in range(rng.randrange(60))]
        expected |= {(f"f{f}", i): m for i, m in enumerate(split_by_hand(lines))}
        block = 0
        for i, line in enumerate(lines):
            block += rng.random() < 0.2
            rows.append((f"f{f}", block * 100, i, line))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "log_path string, block long, pos long, line string")
    got = {(r["log_path"], r["message_number"]): list(r["lines"]) for r in logs.split_frames(df).collect()}
    assert got == expected


def test_log_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "20240105_P.log").write_bytes(
        "noise\n<SB>\nMSH|±60%÷<R>\nPID|1<R>\n<EB>\n<SB>\n<EB>\n".encode("latin-1")
    )
    (tmp_path / "sub" / "20240105.log").write_text("nothing here\n")
    (tmp_path / "20240106.txt").write_text("<SB>\nMSH\n<EB>\n")
    found = logs.discover_logs(spark, str(tmp_path), "2024-01-05")
    assert found.count() == 2
    messages = logs.read_discovered_logs(spark, str(tmp_path), found)
    ok, errors = logs.validate_messages(messages, found)
    good = ok.collect()
    assert [(r["message_number"], list(r["lines"])) for r in good] == [(0, ["MSH|±60%÷", "PID|1", ""])]
    assert str(good[0]["log_date"]) == "2024-01-05"
    assert sorted(r["error_message"] for r in errors.collect()) == [logs.EMPTY_MESSAGE, logs.NO_MESSAGES]
    with pytest.raises(FileNotFoundError):
        logs.discover_logs(spark, str(tmp_path), "2031-01-01")


def test_frames_across_blocks_and_batches(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["MSH|1<R>", "text", "", "<SB>", "<EB>", "x<EB>y<R>", "<SB><EB>", "a<SB>b", "<R>"]
    expected = {}
    for f in range(3):
        lines = [rng.choice(pieces) for _ in range(400)] + ["end"]
        (tmp_path / f"f{f}.log").write_text("\n".join(lines))
        expected |= {(f"f{f}.log", i): m for i, m in enumerate(split_by_hand(lines))}
    small = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    held = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        split = logs.read_message_logs(spark, str(tmp_path))
        # Lines are folded where they are read; a window would sort and spill every one of them.
        assert "Window" not in split._jdf.queryExecution().executedPlan().toString()
        got = {(r["log_path"].split("/")[-1], r["message_number"]): list(r["lines"]) for r in split.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == expected


MESSAGE = "MSH|^~\\&|LAB|X|||201001010830||ORU^R01|7|P|2.7\rPID|1|M1|5^^^EPIC^MRN~6^^^^^FH||A^B\rORC|RE|P7|F7\rOBR|1||\rOBX|1|TX|1&GDT||a~b\rOBX|2|ST|1&IMP||c"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_message_is_parsed_once_for_its_report(spark):
    content = spark.createDataFrame([("a", MESSAGE), ("b", MESSAGE.replace("F7", " ")), (None, None)], "source_file string, content string")
    curated = curate.curate(curate.build_reports(parse_messages(content, keep=["source_file"])))
    found = curated.select("accession_number", "primary_patient_identifier", "report_section_findings").collect()
    assert [tuple(r) for r in found] == [("F7", "epic_mrn_5", "a\nb")]
    # The filter on the accession number does not repeat the parse below.
    assert optimized(curated).count("regexp_extract_all") == 1


def test_the_unparsable_are_told_without_reading_content_again(spark):
    content = spark.createDataFrame([("a", MESSAGE), ("b", "none"), (None, None)], "source_file string, content string")
    good, errors = curate.split_unparsable(parse_messages(content, keep=["source_file"]))
    assert good.columns == ["source_file", "message", "segments"]
    assert [r["source_file"] for r in good.collect()] == ["a"]
    assert [r["file_path"] for r in errors.sort("file_path").collect()] == [None, "b"]
    assert not any("Filter" in line and "regexp_extract" in line for line in optimized(good).split("\n"))
    # Repetitions, diagnoses and lines are split once each, not once for every part of them.
    assert optimized(curate.build_reports(good)).count("split(lambda") < 15
