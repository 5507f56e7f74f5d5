from collections import defaultdict

from riskbook.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    docs = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOW)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(d)
    gone = {k for k, v in docs.items() if k and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def dropped(frame, rows, **options):
    docs = frame([(d, t, "x") for d, t in rows], "doc_id long, text string, lines_before string")
    found = line_dedup.drop_common_lines(docs.drop("lines_before"), **options).collect()
    return sorted((str(r["doc_id"]), r["lines_before"], r["lines_dropped"], r["text"]) for r in found)


def test_lines(frame):
    rows = [(i, f"line {i}\n Common LINE \t\n\nÄ {i % 12}\n{'rare' if i < 9 else 'x'}") for i in range(40)]
    rows += [(100 + i, "common line") for i in range(5)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\r\ncommon line\x0b\n"), (204, "common line"), (None, "common line\nz"), (None, "q")]
    rows += [(205, "y " * 200_000 + "\ncommon line"), (39, "common line\nagain")]
    assert dropped(frame, rows) == brute(rows)


def test_repeated_rows_count_once(frame):
    rows = [(1, "same\na")] * 12 + [(2, "same\nb")]
    assert dropped(frame, rows) == brute(rows)
    assert dropped(frame, rows, least_documents=2) == brute(rows, 2)


def test_case_folds_in_ascii_only(frame):
    rows = [(i, "É ABC" if i % 2 else "é abc") for i in range(18)]
    assert dropped(frame, rows) == brute(rows)


def test_empty_table_and_clashing_names(frame):
    assert dropped(frame, []) == []
    docs = frame([(1, "a", "b", "c")], "doc_id long, text string, lines_before string, key string")
    (row,) = line_dedup.drop_common_lines(docs).collect()
    assert (row["text"], row["key"], row["lines_before"]) == ("a", "c", 1)


def test_no_python_in_the_plan(frame):
    docs = frame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.drop_common_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_the_names_of_its_own(frame):
    docs = frame([(i, f"same\n{i}", 1, "b", 2.0) for i in range(12)], "doc_id long, text string, _line_drop int, _line_doc string, _Line_Kept double")
    rows = line_dedup.drop_common_lines(docs).collect()
    assert sorted((r["text"], r["_line_drop"], r["_line_doc"], r["_Line_Kept"]) for r in rows) == sorted((str(i), 1, "b", 2.0) for i in range(12))
