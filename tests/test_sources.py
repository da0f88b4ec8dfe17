import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.cli import main
from veilframe.errors import ParseError
from veilframe.operators.profile import detect, histogram, name_kind, numeric_stats, schema_profile, correlations
from veilframe.sources import sqldump
from veilframe.sources.splits import Delimited, lines_of, records, starts
from veilframe.sources.sqldump import column_list, statements
from veilframe.sources.tables import file_encoding, read_table, sniff_separator


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_csv_types_and_nulls(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,x,ok,day,at,clock,name\n1,1.5,true,2020-01-02,2020-01-02 03:04:05,08:00:00,"a, b"\n2,NA,false,,N/A,null,"line\nbreak"\n')
    df = read_table(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "date", "timestamp_ntz", "string", "string"]
    rows = df.orderBy("id").collect()
    assert rows[0].name == "a, b" and rows[1].name == "line\nbreak" and rows[1].x is None and rows[1].clock is None
    assert {e["name"]: e["kind"] for e in schema_profile(df)}["clock"] == "datetime"


def test_loose_values_stay_text(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.csv", "a,b,c,d\ny,1d,2020,2020-13-01\n1,2,2021,2020-01-01\n"))
    assert [t for _, t in df.dtypes] == ["string", "string", "bigint", "string"]


def test_bad_files(spark, tmp_path):
    for name, text in (("a.csv", "a,b\n1,2,secretcell\n"), ("b.csv", "a,b\n"), ("c.csv", ""), ("d.xyz", "a"), ("e.txt", "a b\nc d e\n"), ("f.sql", "SELECT 1;"), ("g.sql", "INSERT INTO t VALUES (1);INSERT INTO u VALUES (2);")):
        with pytest.raises(ParseError) as e:
            read_table(spark, write(tmp_path, name, text))
        assert "secretcell" not in str(e.value)
    with pytest.raises(ParseError):
        read_table(spark, write(tmp_path, "h.csv", "a\n1\n"), max_bytes=2)


def test_txt_and_encodings(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.txt", "\n" * 15 + "a|b\n1|x\n2|y\n"))
    assert df.columns == ["a", "b"] and df.count() == 2
    assert sniff_separator("a\tb,c\n1\t2,3\n") == "\t" and sniff_separator("a;b;c,d\n1;2;3,4") == ";"
    for text, code in (("姓名,電話", "utf-8-sig"), ("姓名はひらがなです", "shift_jis"), ("姓名はひらがなです", "euc_jp"), ("이름은 김철수", "euc_kr"), ("姓名與電話號碼的資料", "big5"), ("привет всем людям", "cp1251"), ("caf\xe9 au lait", "cp1252"), ("plain", "ascii")):
        found = file_encoding(spark, write(tmp_path, "c.csv", f"{text}\n", code))
        assert text.encode(code).decode(found).lstrip("\ufeff") == text
    df = read_table(spark, write(tmp_path, "b.csv", "姓名,x\nひらがなのなまえ,1\n", "shift_jis"))
    assert df.first()[0] == "ひらがなのなまえ"


SQL = """-- a comment; INSERT INTO no VALUES (0);
CREATE TABLE t (a int, `b c` text);
INSERT INTO "s"."t" (a, "b, c", [d]) VALUES (1, 'it''s -- not /* a */ comment', NULL), (0x1F, "x\\ty\\q\\x41", 3.5),;
insert into "s"."t" (a, "b, c", [d]) values (-2, 'é', 1e3);
"""


def test_sql(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.sql", SQL))
    assert df.columns == ["a", "b, c", "d"] and [t for _, t in df.dtypes] == ["bigint", "string", "double"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(-2, "é", 1000.0), (1, "it's -- not /* a */ comment", None), (31, "x\ty\\qA", 3.5)]


def test_statements_over_many_lines(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.sql", "/* two\nlines */ INSERT INTO t\n(a,\n b)\nVALUES\n(1,\n'x\ny'),\n(2, NULL)\n;\n"))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, None)]


def test_sql_errors():
    for bad in ("INSERT INTO t VALUES (1", "INSERT INTO t VALUES ('a)", "INSERT INTO t VALUES (now())", "INSERT INTO t VALUES ((1))", "INSERT INTO t VALUES (DEFAULT)", "INSERT INTO t (a) VALUES (1, 2)", 'INSERT INTO t ("a VALUES (1)'):
        with pytest.raises(ParseError):
            list(statements(bad))
    assert column_list('a, `b``c`, "d, e", [f g]') == ["a", "b`c", "d, e", "f g"]


def test_names():
    want = {"email": "email", "E-Mail": "email", "contact_phone": "phone", "電話": "phone", "user_national_id": "identifier", "order id": "identifier", "paid": None, "dob": "date_of_birth", "ZIP": "address", "creditCard": "credit_card"}
    assert {n: name_kind(n) for n in want} == want


def test_detection(spark):
    n = 40
    rows = [(f"u{i}@x.org", f"+1 212-555-{i:04d}", f"4111 1111 1111 1{i % 1:03d}", f"id{i}", i % 3, f"w{i}") for i in range(n)]
    found = detect(spark.createDataFrame(rows, "contact string, tel string, card string, order_id string, cat_id int, note string"))
    kinds = {c: x[0].kind for c, x in found.items()}
    assert kinds["contact"] == "email" and kinds["tel"] == "phone" and kinds["order_id"] == "identifier" and kinds["cat_id"] == "none" and kinds["note"] == "identifier"
    assert found["tel"][0].confidence <= 0.99 and found["note"][0].confidence == 0.60
    assert detect(spark.createDataFrame([("+44 20 7946 0958",), ("+886 912 345 678",), ("12",)], "a string"))["a"][0].kind == "none"


def test_statistics_ignore_nan(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (float("nan"), 5), (3.0, 5), (4.0, 5)], "x double, k int")
    assert sum(r.n for r in histogram(df, "x").collect()) == 4
    assert numeric_stats(df, ["x"]).first().maximum == 4.0
    assert {(r.a, r.b): r.r for r in correlations(df, ["x", "k"]).collect()}[("x", "k")] is None
    assert histogram(df, "k").count() == 1


def test_command_line(spark, tmp_path, capsys):
    rows = "".join(f"p{i}@x.org,{['N', 'S'][i % 2]},{i % 5}\n" for i in range(40))
    path = write(tmp_path, "people.csv", "email,area,level\n" + rows)
    assert main(["process", path, "--output", str(tmp_path), "-k", "3"]) == 0
    text = (tmp_path / "people.sanitized.csv").read_text()
    assert "@" not in text and len(text.splitlines()) == 41
    assert json.loads((tmp_path / "people.report.json").read_text())["k_anonymity"]["k_target"] == 3
    assert (tmp_path / "people.report.md").read_text().startswith("# Release")
    assert main(["process", path, "-k", "1"]) == 1 and "error" in capsys.readouterr().err
    assert main(["process", str(tmp_path / "none.csv")]) == 1
    assert main(["profile", path]) == 0 and main(["preflight", path]) == 0


def test_stream(spark, tmp_path):
    from veilframe.plans.policy import Policy, Request
    from veilframe.streaming.batches import release_batches, transformed

    source = tmp_path / "in"
    spark.createDataFrame([("a", i) for i in range(6)] + [("b", 1)], "g string, n int").write.parquet(str(source))
    stream = spark.readStream.schema("g string, n int").parquet(str(source))
    req = Request((Policy("g", is_quasi_identifier=True), Policy("n", "numeric_bin", {"bin_width": 2})), k=3, accept_weaker=True)
    q = release_batches(stream, req, str(tmp_path / "out"), b"k").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    q = transformed(stream, req, b"k").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 7


def test_log_hides_values():
    import logging

    from veilframe.log import Formatter

    record = logging.LogRecord("a", logging.INFO, "", 0, "done", (), None)
    record.fields = {"key": "abc", "n": 3, "inner": {"row": ["x"]}}
    assert json.loads(Formatter().format(record)) == {"level": "INFO", "logger": "a", "message": "done", "key": "(hidden)", "n": 3, "inner": {"row": "(hidden)"}}


def test_all_lines_tell_the_encoding(spark, tmp_path):
    """A byte far behind the start that is no UTF-8."""
    head = "name,n\n" + "".join(f"plain{k},{k}\n" for k in range(20_000))
    df = read_table(spark, write(tmp_path, "late.csv", head + "ein caf\xe9 und stra\xdfe,1\n", "cp1252"))
    assert df.where("name like 'ein%'").first().name == "ein caf\xe9 und stra\xdfe" and df.count() == 20_001
    path = tmp_path / "none.csv"
    path.write_bytes(head.encode() + b"\x81\x8d\xff\xfe\x81,1\n")
    with pytest.raises(ParseError):
        read_table(spark, str(path))


def test_a_long_header_is_read_whole(spark, tmp_path):
    names = [f"a_rather_long_column_name_of_number_{k}" for k in range(6000)]
    assert len(",".join(names)) > 200_000
    from veilframe.sources.tables import _first_record, _header, _start

    path = write(tmp_path, "wide.csv", "\n\n" + ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    first = lambda text: _first_record(text, ",")
    assert _header(first(_start(spark, path, "utf-8", first)), ",") == names


def test_quoted_line_breaks_at_any_size(spark, tmp_path):
    """Files are split among tasks only if no record holds a line break."""
    plain = "".join(f'{k},"x, {k}"\n' for k in range(30_000))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        path = write(tmp_path, "plain.csv", "n,s\n" + plain)
        assert read_table(spark, path).count() == 30_000
        path = write(tmp_path, "breaks.csv", "n,s\n" + plain + '30000,"two\nlines, ""quoted"""\n' + plain)
        df = read_table(spark, path)
        assert df.count() == 60_001
        assert df.where("n = 30000").first().s == 'two\nlines, "quoted"'
    finally:
        spark.conf.set(key, before)


def test_refused_batches_are_told(spark, tmp_path):
    from veilframe.plans.policy import Policy, Request
    from veilframe.streaming.batches import release_batches

    spark.createDataFrame([(1, "a"), (2, "b")], "n long, g string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, g string").parquet(str(tmp_path / "in"))
    request = Request((Policy("g", is_quasi_identifier=True),), k=5)
    query = release_batches(stream, request, str(tmp_path / "out"), b"k" * 32).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    refused = spark.read.parquet(str(tmp_path / "out.refused")).first()
    assert refused.rows == 2 and not (tmp_path / "out").exists()


#: Two rows of names that no sample of the models holds.
NAMES = [
    ("koi8_r", "имя,город\nБорис Лебедев,Казань\nОльга Соколова,Тверь\n"), ("cp1251", "имя,город\nБорис Лебедев,Казань\nОльга Соколова,Тверь\n"), ("cp866", "имя,город\nБорис Лебедев,Казань\nОльга Соколова,Тверь\n"), ("iso8859_5", "имя,город\nБорис Лебедев,Казань\nОльга Соколова,Тверь\n"),
    ("koi8_u", "ім'я,місто\nЄвген Коваленко,Чернігів\nЇвга,Кривий Ріг\n"), ("cp1253", "όνομα,πόλη\nΝικόλαος Ιωάννου,Πάτρα\nΣοφία Γεωργίου,Βόλος\n"), ("cp1250", "imię,miasto\nŁucja Wiśniewska,Poznań\nGrażyna Wójcik,Częstochowa\n"), ("iso8859_2", "imię,miasto\nŁucja Wiśniewska,Poznań\nGrażyna Wójcik,Częstochowa\n"),
    ("cp1250", "jméno,město\nKateřina Svobodová,Brno\nOndřej Procházka,Děčín\n"), ("cp1250", "név,város\nNagy Gergő,Szeged\nTóth Ilona,Hódmezővásárhely\n"), ("tis_620", "ชื่อ,เมือง\nสมศรี,ภูเก็ต\nประยุทธ์,ขอนแก่น\n"), ("cp1255", "שם,עיר\nיעקב,באר שבע\nמרים,נתניה\n"),
    ("cp1256", "الاسم,المدينة\nخالد,جدة\nمريم,دمشق\n"), ("cp1254", "isim,şehir\nMehmet Yıldız,Kütahya\nGülşah Aydın,Şanlıurfa\n"), ("cp1257", "vardas,miestas\nJonas Kazlauskas,Šilutė\nRūta Žukauskienė,Kėdainiai\n"), ("cp1252", "name,city\nIñaki Núñez,Málaga\nAndré Müller,Zürich\n"),
    ("mac_roman", "name,city\nIñaki Núñez,Málaga\nAndré Müller,Zürich\n"), ("cp850", "name,city\nIñaki Núñez,Málaga\nAndré Müller,Zürich\n"), ("shift_jis", "名前,値\n佐々木健一,横浜市\nスズキ,千葉\n"), ("euc_jp", "名前,値\n佐々木健一,横浜市\nスズキ,千葉\n"),
    ("gb18030", "姓名,城市\n孙丽华,深圳\n郭强,成都\n"), ("big5", "姓名,城市\n吳美玲,新竹\n蔡英俊,臺中\n"), ("euc_kr", "이름,도시\n박지훈,대구\n최수연,인천\n"), ("utf-16", "姓名,ville\n孙丽华,Orléans\n\"a\nb\",Łódź\n"), ("utf-16-be", "\ufeffname,x\nÉmile,1\nЖуков,2\n"),
]


def test_encodings_of_two_rows(spark, tmp_path):
    for k, (code, text) in enumerate(NAMES):
        path = write(tmp_path, f"t{k}.csv", text, code)
        assert text.encode(code).decode(file_encoding(spark, path)).lstrip("\ufeff") == text.lstrip("\ufeff"), code
        if k % 8 != 7 and "utf" not in code:
            continue
        got = read_table(spark, path)
        head, *rows = csv.reader(io.StringIO(text.lstrip("\ufeff")))
        assert got.columns == head and sorted(tuple(map(str, r)) for r in got.collect()) == sorted(map(tuple, rows)), code


def test_unknown_encodings_are_refused_and_can_be_named(spark, tmp_path):
    (tmp_path / "noise.csv").write_bytes(b"a,b\n" + bytes(b for k in range(3000) for b in [(k * k * 31 + k * 7) % 251 + 5] if b != 10) + b",1\n")
    text = "name,city\nhello world,Köln\nΑθήνα ½,x\n"
    for path in (str(tmp_path / "noise.csv"), write(tmp_path, "ebcdic.csv", "name,city\nhello world this is\n", "cp037")):
        with pytest.raises(ParseError):
            read_table(spark, path)
    path = write(tmp_path, "greek.csv", text.replace("ö", "o"), "cp1253")
    assert {r.name for r in read_table(spark, path, encoding="cp1253").collect()} == {"hello world", "Αθήνα ½"}


def test_dumps_in_other_encodings(spark, tmp_path):
    text = "-- größe\nINSERT INTO t (`größe`, b) VALUES ('Müller & Söhne, Zürich', 1),\n('Jörg', 2);\n"
    for k, code in enumerate(("cp1252", "utf-16", "utf-8-sig")):
        df = read_table(spark, write(tmp_path, f"d{k}.sql", text, code))
        assert df.columns == ["größe", "b"] and {r[0] for r in df.collect()} == {"Müller & Söhne, Zürich", "Jörg"}


def test_types_lose_nothing(spark, tmp_path):
    head = "id,wide,wider,f,g,h,exp,mixed,zip,at,off,both,over\n"
    rows = [
        ["1234567890123456789", "12345678901234567890", "9" * 40, "0.1", "0.30000000000000004", "3.14159265358979323846", "1.5e300", "1", "02139", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+02:00", "2026-01-02 03:04", "1e999"],
        ["1234567890123456788", "-1", "1", "2", "5.684341886080802E-14", "2.5", "1e-5", "9007199254740993.5", "10001", "2026-01-02 03:04:05.123456Z", "2026-01-02 03:04:05.5 -0330", "2026-01-02 03:04+01", "1"],
    ]
    df = read_table(spark, write(tmp_path, "a.csv", head + "".join(",".join(r) + "\n" for r in rows)))
    kinds = dict(df.dtypes)
    assert kinds == {"id": "bigint", "wide": "decimal(38,0)", "wider": "string", "f": "double", "g": "double", "h": "decimal(38,20)", "exp": "double", "mixed": "decimal(38,1)", "zip": "bigint", "at": "timestamp_ntz", "off": "timestamp", "both": "string", "over": "string"}
    got = sorted(df.collect(), key=lambda r: -r.id)
    assert [r.id for r in got] == [1234567890123456789, 1234567890123456788] and [int(r.wide) for r in got] == [12345678901234567890, -1]
    assert [r.g for r in got] == [0.30000000000000004, 5.684341886080802e-14] and str(got[0].h) == "3.14159265358979323846" and str(got[1].mixed) == "9007199254740993.5"
    assert [r.wider for r in got] == ["9" * 40, "1"]
    utc = df.select("id", F.date_format("off", "yyyy-MM-dd HH:mm:ss.S").alias("t")).orderBy(F.desc("id")).collect()
    assert [r.t for r in utc] == ["2026-01-02 01:04:05.0", "2026-01-02 06:34:05.5"]


def test_literals_lose_nothing(spark, tmp_path):
    text = "INSERT INTO t VALUES (0xFFFFFFFFFFFFFFFF, 12345678901234567890, 1.5, 1, 1" + "0" * 40 + "), (-1, 1, 2, 0.12345678901234567890, 5);"
    df = read_table(spark, write(tmp_path, "a.sql", text))
    assert [k for _, k in df.dtypes] == ["decimal(38,0)", "decimal(38,0)", "double", "decimal(38,19)", "string"]
    rows = sorted(tuple(map(str, r)) for r in df.collect())
    assert rows == sorted([("18446744073709551615", "12345678901234567890", "1.5", "1.0000000000000000000", "1" + "0" * 40), ("-1", "1", "2.0", "0.1234567890123456789", "5")])


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_quoted_records_across_blocks(spark, tmp_path, small_blocks):
    """Stray quotes, breaks in quotes, records longer than blocks: many tasks, and the rows of a plain reader."""
    rng = random.Random(2)
    rows = []
    for k in range(400):
        cell = rng.choice(["plain", 'a "quoted" word', "two\nlines", "", '"', "x,y", '\n\n,"\n', "z" * rng.choice([1, 900]), "é\n日本"])
        rows.append([str(k), cell, rng.choice(["end", 'ends in "', "3\r\n4"])])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "a", "b"], *rows])
    stray = out.getvalue() + '400,5" disk,x\n401,6" and 7",y\n'
    rows += [["400", '5" disk', "x"], ["401", '6" and 7"', "y"]]
    path = write(tmp_path, "a.csv", stray)
    grammar = Delimited(",")
    lines = lines_of(spark, path)
    assert lines.rdd.getNumPartitions() > 50
    begins, within = starts(lines, grammar)
    assert within
    found = records(spark, path, grammar, begins)
    texts = [r.text for r in found.orderBy("block", "phase", "seq").collect()]
    assert "".join(texts) == stray and len(texts) == len(rows) + 1
    got = read_table(spark, path)
    norm = lambda s: (s or "").replace("\r\n", "\n")
    assert sorted((str(r.id), norm(r.a), norm(r.b)) for r in got.collect()) == sorted((i, norm(a), norm(b)) for i, a, b in rows)
    # A stray quote alone leaves the file to Spark's own source.
    path = write(tmp_path, "b.csv", 'id,size 5",b\n' + "".join(f'{k},{k}" disk,x\n' for k in range(300)))
    assert not starts(lines_of(spark, path), grammar)[1]
    df = read_table(spark, path)
    assert df.columns == ["id", 'size 5"', "b"] and df.where("`size 5\"` = '17\" disk'").count() == 1


def test_dumps_do_not_depend_on_blocks(spark, tmp_path, small_blocks, monkeypatch):
    """INSERTs of many shapes, cut anywhere: the rows of the scanner over the whole text."""
    rng = random.Random(4)
    parts = ["-- it's a dump; INSERT INTO no VALUES (0);\n/* '\n;(( */ CREATE TABLE t (a int DEFAULT (1),\n b text, c text);\n"]
    for k in range(45):
        text = lambda: rng.choice(["x", "it''s", "a\\'b", "two\nlines", "; -- no", "(", "),\n(", "/* no", '"', "\\\\", "é", "y" * rng.choice([1, 700]), "INSERT INTO u VALUES (1);"])
        rows = [f"({k}{j}, '{text()}', {rng.choice(['NULL', '1.5', 'TRUE' if False else '2'])})" for j in range(rng.choice([1, 3, 9]))]
        parts.append(rng.choice(["INSERT INTO t (a, `b`, [c]) VALUES ", "insert into t\n(a,\n b, c)\nVALUES\n", "INSERT INTO t (a, b, c) VALUES -- why, not;\n"]) + rng.choice([",", ",\n", ", -- c'\n", "\n,\n"]).join(rows) + rng.choice([";\n", ";", "\nON DUPLICATE KEY UPDATE a = 1,\n b = 'z(';\n"]))
    whole = "".join(parts)
    path = write(tmp_path, "a.sql", whole)
    want = sorted((int(v[0]), v[1]) for _, _, v, _ in statements(whole))
    assert len(want) > 120 and lines_of(spark, path).rdd.getNumPartitions() > 20
    for piece, long in ((50, 1 << 24), (200, 10)):
        monkeypatch.setattr(sqldump, "_PIECE", piece)
        monkeypatch.setattr(sqldump, "_LONG", long)
        monkeypatch.setattr(sqldump.pieces, "__defaults__", (piece,))
        df = read_table(spark, path)
        assert sorted((r.a, r.b) for r in df.collect()) == want and dict(df.dtypes)["c"] == "double"
    one = "INSERT INTO t VALUES " + ",".join(f"({k}, 'v{k}, w')" for k in range(500)) + ";"  # a single line
    found, _ = sqldump.pieces(spark, write(tmp_path, "one.sql", one), "utf-8", ",", 50)
    assert found.count() > 10
    assert sorted((r.col_0, r.col_1) for r in read_table(spark, str(tmp_path / "one.sql")).collect()) == [(k, f"v{k}, w") for k in range(500)]
    with pytest.raises(ParseError):
        read_table(spark, write(tmp_path, "bad.sql", whole + "INSERT INTO t (a, b, c) VALUES (1, 'open"))


def test_lines_of_a_dump_are_scanned_as_tokens_are():
    """From each state, the step of a line is that of its tokens, and comment marks that overlap quotes change nothing."""
    import random

    from veilframe.sources import sqldump

    def by_tokens(state, text):
        anew, depth, last = False, 0, ""
        for state, token, _ in sqldump._tokens(text, state):
            last = token or last
            if token == ";":
                anew, depth = True, 0
            depth += (token == "(") - (token == ")")
        return state, anew, depth, state == 0 and last in (",", ";")

    rng, dump = random.Random(5), sqldump.Dump()
    parts = ["'", "''", '"', '""', "`", "[", "]", "(", ")", ",", ";", "--", "-", "/", "*", "/*", "*/", "\\", "\\'", " ", "a", "INSERT INTO t VALUES", "0xF", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12))) + rng.choice(["\n", ","])
        for state in range(dump.states):
            assert dump.line(state, text) == by_tokens(state, text), (state, text)


def test_long_dumps_are_scanned_outside_of_python(monkeypatch):
    """Lines without an end of what is open, or of whole strings, are not walked token by token."""
    from veilframe.sources import sqldump

    monkeypatch.setattr(sqldump, "_tokens", None)
    line = "(0xFF, '1-URGENT -- it''s; (1),\n(''no'')', 2.5),\n"
    assert sqldump.Dump().line(0, line) == (0, False, 0, True) and sqldump.last_header(line * 1000) is None
