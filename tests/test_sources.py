"""Files in and out."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from cartloom.operators import settings_edit as E
from cartloom.sources import export, orders, settings

HEADER = "Pickup Site,First Name,Last Name,Order\n"


def write(path, text, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


def test_reads_quoted_orders_with_bom(spark, tmp_path):
    text = HEADER + 'Shop, Ann ,Bell,"1 Half, 1x1 Egg ""big"""\nMill,NA,"",\n'
    got = orders.load_members(spark, write(tmp_path / "a.csv", text, bom=True)).orderBy("id").collect()
    assert [(r.id, r.group_name, r.firstname, r.lastname, r.order) for r in got] == [
        (1, "Shop", "Ann", "Bell", '1 Half, 1x1 Egg "big"'),
        (2, "Mill", None, None, None),
    ]


def test_ragged_rows_are_an_error_or_set_aside(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", HEADER + 'S,A,B,"1x a, 2x b"\nS,C,D,1x a,2x b,3x c\nS,E\nS,F,G,1x a\n', bom=True)
    write(folder / "b.csv", HEADER + 'S,H,I,\nonly a note\nS,K,L,"1x d"\n')
    with pytest.raises(ValueError, match="a.csv row 2: S,C,D,1x a,2x b,3x c; .*a.csv row 3: S,E; .*b.csv row 2: only a note"):
        orders.load_members(spark, str(folder))
    files = orders.load_orders(spark, str(folder))
    assert [(r.id, r.firstname, r.lastname, r.order) for r in files.members.orderBy("id").collect()] == [
        (1, "A", "B", "1x a, 2x b"), (4, "F", "G", "1x a"), (5, "H", "I", None), (7, "K", "L", "1x d"),
    ]
    assert files.members.columns == ["group_name", "firstname", "lastname", "order", "id"]
    aside = [(r.source_file.rsplit("/", 1)[1], r.file_row, r.record) for r in files.quarantined.collect()]
    assert sorted(aside) == [
        ("a.csv", 2, "S,C,D,1x a,2x b,3x c"), ("a.csv", 3, "S,E"), ("b.csv", 2, "only a note"),
    ]


def test_ragged_rows_with_line_ends(spark, tmp_path):
    path = write(tmp_path / "m.csv", HEADER + 'S,A,B,"1x a,\n2x b"\nS,C,D,1x a,2x b\nS,E,F,1x c\n')
    files = orders.load_orders(spark, path, multi_line=True)
    assert [(r.id, r.order) for r in files.members.orderBy("id").collect()] == [(1, "1x a,\n2x b"), (3, "1x c")]
    assert [(r.file_row, r.record) for r in files.quarantined.collect()] == [(2, "S,C,D,1x a,2x b")]


def test_rows_set_aside_keep_their_places_over_blocks(spark, tmp_path):
    rows = [f"S,a{i},L,x" if i % 7 else f"S,a{i},L,x,y" for i in range(3000)]
    path = write(tmp_path / "many.csv", HEADER + "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        files = orders.load_orders(spark, path)
        kept = {r.id: r.firstname for r in files.members.collect()}
        aside = {r.file_row: r.record for r in files.quarantined.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert kept == {i + 1: f"a{i}" for i in range(3000) if i % 7}
    assert aside == {i + 1: f"S,a{i},L,x,y" for i in range(0, 3000, 7)}


def test_ids_follow_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = {f"{name}.csv": [f"{name}{i:03d}" for i in range(size)] for name, size in (("b", 7), ("a", 300), ("c", 50))}
    for name, members in rows.items():
        write(folder / name, HEADER + "".join(f"S,{m},L,x\n" for m in members))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = orders.load_members(spark, str(folder))
        assert df.rdd.getNumPartitions() >= 1
        got = [(r.id, r.firstname) for r in df.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [m for name in sorted(rows) for m in rows[name]]
    assert got == list(enumerate(want, 1))


def test_no_row_is_lost_when_split_sizes_change(spark, tmp_path):
    path = write(tmp_path / "many.csv", HEADER + "".join(f"S,a{i},L,x\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        df = orders.load_members(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
        got = df.select("id", "firstname").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.id, r.firstname) for r in got) == [(i + 1, f"a{i}") for i in range(20_000)]


def test_every_file_of_a_folder_has_its_header_checked(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", HEADER + "S,Ann,Bell,x\n")
    write(folder / "b.csv", "Last Name,First Name,Pickup Site\nBell,Bo,S\n")
    with pytest.raises(Exception, match="b.csv|header"):
        orders.load_members(spark, str(folder)).collect()


def test_rejects_other_headers(spark, tmp_path):
    with pytest.raises(ValueError, match="not of the correct format"):
        orders.read_member_orders(spark, write(tmp_path / "n.csv", "Pickup Site,First Name,Last Name\nS,a,b\n"))
    with pytest.raises(ValueError, match="not of the correct format"):
        orders.read_member_orders(spark, write(tmp_path / "m.csv", "pickup site,First Name,Last Name,Order\nS,a,b,c\n"))


def test_multi_line_fields(spark, tmp_path):
    text = HEADER + 'Shop,Ann,Bell,"1 Half,\n1x1 Egg"\n'
    got = orders.load_members(spark, write(tmp_path / "m.csv", text), multi_line=True).collect()
    assert [r.order for r in got] == ["1 Half,\n1x1 Egg"]


def deletes(spark, *items):
    return spark.createDataFrame([(i,) for i in items], settings.DELETES)


def listed(df):
    return sorted(r.item or "" for r in df.collect())


def test_settings_scan_replace_and_export(spark, tmp_path):
    table = settings.SettingsTable(spark, str(tmp_path / "delete"), settings.DELETES)
    assert table.version() == 0 and table.read().count() == 0
    assert table.replace(deletes(spark, "a", None, "b"), base=0) == 1
    old = table.read()
    assert table.update(lambda rows: E.append_distinct(rows, deletes(spark, "b", "c"))) == 2
    assert listed(table.read()) == ["", "a", "b", "c"]
    # a reader of the version before still has it whole
    assert listed(old) == ["", "a", "b"]
    table.update(lambda rows: E.remove_item(rows, "b"))
    assert listed(table.read()) == ["a", "c"] and listed(table.read(1)) == ["", "a", "b"]
    table.drop_old(keep=1)
    assert table.versions() == [3] and listed(table.read()) == ["a", "c"]
    assert len(list(tmp_path.glob("delete/data-*"))) == 1
    out = str(tmp_path / "out")
    export.export_table(table.read(), out, "csv")
    assert listed(settings.read_settings(spark, out, settings.DELETES, "csv")) == ["a", "c"]


def test_a_moved_base_is_refused(spark, tmp_path):
    table = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
    table.replace(deletes(spark, "a"), base=0)
    table.replace(deletes(spark, "b"), base=1)
    with pytest.raises(settings.StaleVersion):
        table.replace(deletes(spark, "c"), base=1)
    # the other writer commits while this one writes its rows
    other = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
    plain = table._commit

    def late(version, folder):
        other.replace(deletes(spark, "d"), base=2)
        plain(version, folder)

    table._commit = late
    with pytest.raises(settings.StaleVersion):
        table.replace(deletes(spark, "e"), base=2)
    assert listed(table.read()) == ["d"] and table.version() == 3
    # what the refused writer wrote is gone
    assert len(list((tmp_path / "t").glob("data-*"))) == 3


@pytest.mark.parametrize("step", ["_commit", "_take"])
def test_a_reader_between_any_two_steps_sees_a_whole_table(spark, tmp_path, step):
    table = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
    reader = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
    table.replace(deletes(spark, "a", "b"), base=0)
    plain, seen = getattr(table, step), []

    def watched(*args):
        seen.append(listed(reader.read()))
        done = plain(*args)
        seen.append(listed(reader.read()))
        return done

    setattr(table, step, watched)
    table.replace(deletes(spark, "c"), base=1)
    assert seen == [["a", "b"], ["c"]]

    def failing(*args):
        raise OSError("lost")

    setattr(table, step, failing)
    with pytest.raises(OSError, match="lost"):
        table.replace(deletes(spark, "x"), base=2)
    assert listed(reader.read()) == ["c"]
    assert reader.update(lambda rows: E.append_distinct(rows, deletes(spark, "y"))) == 3


def test_writers_at_the_same_time_lose_no_row(spark, tmp_path):
    def write_some(name):
        table = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
        for k in range(4):
            table.update(lambda rows, k=k: E.append_distinct(rows, deletes(spark, f"{name}{k}")))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write_some, "abc"))
    table = settings.SettingsTable(spark, str(tmp_path / "t"), settings.DELETES)
    assert listed(table.read()) == sorted(f"{n}{k}" for n in "abc" for k in range(4)) and table.version() == 12


def test_duplicate_settings_are_reported(spark):
    shares = spark.createDataFrame([("G",), ("G",), ("H",)], "group_name string")
    assert [r.group_name for r in settings.duplicate_keys(shares, "group_name").collect()] == ["G"]
    with pytest.raises(ValueError, match="duplicate keys"):
        settings.require_unique(shares, "group_name")
