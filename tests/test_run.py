"""Runs: registry list, error isolation, user rules, sink and summary."""

import pytest
from pyspark.sql import functions as F

from conftest import bag
from linderos.plans.run import run_rules, run_rule
from linderos.plans.sink import read_violations
from linderos.rules import Rule, catalogue, register_rule, select_rules, unregister_rule
from linderos.schema import VIOLATION
from linderos.sources.r1 import R1Error, read_r1_csv
from linderos.sources.tables import Cadastre, load_tables

NEED_R1 = {"RN-02", "RN-07", "RN-17", "RN-19", "RN-20", "RN-22", "RN-26"}
USER_SQL = Rule(
    id="X-01", descripcion="area", categoria="propia",
    sql="SELECT 'cca_terreno', T_Id, NULL, 'grande', AREA, {tope} FROM cca_terreno WHERE AREA > {tope}", parametros={"tope": 400},
)


def by_id(*ids):
    return [r for r in catalogue() if r.id in ids]


@pytest.fixture()
def r1_csv(tmp_path):
    path = tmp_path / "r1.csv"
    path.write_text("﻿id,Numero_Predial,predial_2\n1, 255 ,x\n2,255,y\n3,,z\n4,\t300 ,w\n5,   ,v\n", encoding="utf-8")
    return str(path)


def test_r1_csv(spark, r1_csv, tmp_path):
    loaded = read_r1_csv(spark, r1_csv)
    assert bag(loaded.numbers.collect()) == [("255",), ("300",)]
    assert loaded.counts() == (3, 2)
    with pytest.raises(R1Error):
        read_r1_csv(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(R1Error):
        read_r1_csv(spark, str(tmp_path / "other.csv"))


def test_registry_list_is_written_by_many_tasks(spark, monkeypatch):
    import __spark_entry__ as driver

    given = driver.tables(spark, driver.SMOKE)["predio"]
    want = driver.r1_counts(spark, driver.SMOKE).collect(), bag(driver.load_r1(spark, driver.SMOKE).collect())
    monkeypatch.setattr(driver, "tables", lambda *_: {"predio": given.repartition(5)})
    files = driver._registry_file(spark, driver.SMOKE).rows.inputFiles()
    assert len(files) == 6 and max(spark.read.text(f).count() for f in files) < given.count()
    assert (driver.r1_counts(spark, driver.SMOKE).collect(), bag(driver.load_r1(spark, driver.SMOKE).collect())) == want
    assert ("A\nB, \"C\"",) in want[1] and want[0][0]["filas"] == given.where("trim(numero_predial_nacional) <> ''").count() + 1


def test_r1_csv_dialect(spark, tmp_path):
    """Quotes, a line break in a field, short and long rows."""
    path = tmp_path / "r1.csv"
    path.write_text('numero_predial,obs\n123,"a\n999"\n"4""5",x\n6\n7,y,z,w\n', encoding="utf-8")
    assert bag(read_r1_csv(spark, str(path)).numbers.collect()) == [("123",), ('4"5',), ("6",), ("7",)]


def test_ready_made_registry_is_normalised(spark, tables):
    raw = spark.createDataFrame([("A",), (" A ",), (" ",), (None,), ("B",)], "numero_predial string")
    given = Cadastre(spark, tables.given | {"_r1_predios": raw})
    assert bag(given["r1"].collect()) == [("A",), ("B",)]


def test_lost_cells_are_reported(spark, tables):
    rows = [(1, 1, "1,5"), (2, 1, "2.5"), (3, 1, None)]
    given = Cadastre(spark, tables.given | {"cca_terreno": spark.createDataFrame(rows, "T_Id long, predio long, AREA string")})
    summary = run_rules(given, rules=by_id("RF-05"))
    assert summary.celdas_perdidas == {"cca_terreno.AREA": 1}


def test_settings_of_the_caller_stay(spark, tables):
    names = ("spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
    before = [spark.conf.get(n, None) for n in names]
    run_rules(tables, rules=by_id("R-14"))
    assert [spark.conf.get(n, None) for n in names] == before
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rules_over_other_tables_and_columns(spark, tables):
    streets = spark.createDataFrame([(1, "Calle"), (2, None)], "T_Id long, via string")
    wide = tables.given["cca_predio"].withColumn("direccion", F.lit("x"))
    given = Cadastre(spark, tables.given | {"cca_direccion": streets, "cca_predio": wide})
    six = "NULL, 'm', NULL, NULL"
    rules = [Rule(id="X-1", descripcion="", categoria="u", sql=f"SELECT 'cca_direccion', T_Id, {six} FROM cca_direccion WHERE via IS NULL"),
             Rule(id="X-2", descripcion="", categoria="u", sql=f"SELECT 'cca_predio', T_Id, {six} FROM cca_predio WHERE direccion = 'x'")]
    summary = run_rules(given, rules=rules + by_id("R-14"))
    counts = {rule_id: n for rule_id, _, _, n in summary.por_regla}
    assert counts["X-1"] == 1 and counts["X-2"] == wide.count() and counts["R-14"] > 0


def test_rules_that_fail_on_a_value_harm_nobody(tables):
    select = "SELECT 'cca_predio', T_Id, NULL, 'm', {}, NULL FROM cca_predio WHERE {}"
    rules = [Rule(id="X-1", descripcion="", categoria="u", sql=select.format("NULL", "cast(condicion_predio || 'x' as int) = 1")),
             Rule(id="X-2", descripcion="", categoria="u", sql=select.format("1 % (T_Id - T_Id)", "true")),
             Rule(id="X-3", descripcion="", categoria="u", sql=select.format("NULL", "true"))]
    summary = run_rules(tables, rules=rules + by_id("R-14"))
    counts = {rule_id: n for rule_id, _, _, n in summary.por_regla}
    assert counts["X-1"] == counts["X-2"] == -1 and counts["X-3"] > 0 and counts["R-14"] > 0


def test_sink_with_odd_category_names(spark, tables, tmp_path):
    path = str(tmp_path / "v")
    sql = "SELECT 'cca_terreno', T_Id, NULL, 'm', NULL, NULL FROM cca_terreno WHERE T_Id > {}"
    rule = lambda least: Rule(id="X-1", descripcion="", categoria="usr:a=b/c %", sql=sql.format(least))
    first = run_rules(tables, rules=[rule(0), *by_id("R-14")], output=path)
    assert read_violations(spark, path).count() == first.total > 0
    again = run_rules(tables, rules=[rule(10**15)], output=path)
    assert again.total == 0
    assert {r.regla_id for r in read_violations(spark, path).select("regla_id").distinct().collect()} == {"R-14"}


def test_run_without_commit_is_never_seen(spark, tables, tmp_path, monkeypatch):
    from linderos.plans import sink

    path = str(tmp_path / "v")
    first = run_rules(tables, rules=by_id("R-14"), output=path)
    monkeypatch.setattr(sink, "MANIFEST", None)  # the commit fails
    with pytest.raises(Exception):
        run_rules(tables, rules=by_id("R-14"), output=path)
    monkeypatch.undo()
    assert read_violations(spark, path).count() == first.total
    sink.drop_replaced(spark, path, str(tmp_path / "w"))
    assert read_violations(spark, str(tmp_path / "w")).count() == first.total


def test_rules_without_registry_are_err_and_harm_nobody(tables):
    summary = run_rules(tables.with_r1(None), rules=by_id("RN-17", "RN-12", "RN-02", "RN-16", "R-08-B"))
    counts = {rule_id: n for rule_id, _, _, n in summary.por_regla}
    assert counts["RN-17"] == counts["RN-02"] == -1
    assert min(counts["RN-12"], counts["RN-16"], counts["R-08-B"]) > 0
    assert summary.estados()["RN-17"] == "ERR" and summary.estados()["RN-12"] == "FAIL"
    assert summary.total == sum(n for n in counts.values() if n > 0)
    assert set(summary.fallos) == {"RN-17", "RN-02"}


def test_bad_registry_list(tables, tmp_path):
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    summary = run_rules(tables, rules=by_id("RN-02", "RN-12"), r1=str(tmp_path / "other.csv"))
    assert dict((r, n) for r, _, _, n in summary.por_regla)["RN-02"] == -1
    assert "r1" in summary.fallos


def test_registry_counts_for_one_run(tables, r1_csv):
    summary = run_rules(tables, rules=by_id("RN-22"), r1=r1_csv)
    assert (summary.r1_filas, summary.r1_distintos) == (3, 2)
    assert summary.errores == 2


def test_missing_column_is_isolated(tables):
    frames = dict(tables.given)
    frames["cca_predio"] = frames["cca_predio"].drop("area_registral_m2")
    summary = run_rules(Cadastre(tables.spark, frames), rules=by_id("R-24-A", "R-01", "R-14"))
    counts = {rule_id: n for rule_id, _, _, n in summary.por_regla}
    assert counts["R-24-A"] == -1 and counts["R-01"] > 0 and counts["R-14"] > 0


def test_user_rules(tables):
    def build(c):
        return c["terreno"].filter("AREA < 1").select(
            F.lit("cca_terreno"), "terreno_id", F.lit(None), F.lit("chico"), "AREA", F.lit(1))

    register_rule(USER_SQL)
    register_rule(Rule(id="X-02", descripcion="chico", categoria="propia", severidad="advertencia", build=build))
    register_rule(Rule(id="X-03", descripcion="roto", categoria="propia", sql="SELECT nada FROM cca_terreno"))
    try:
        summary = run_rules(tables, categorias=["propia"])
        counts = {rule_id: n for rule_id, _, _, n in summary.por_regla}
        assert counts["X-01"] == tables["terreno"].filter("AREA > 400").count() > 0
        assert counts["X-02"] == summary.advertencias > 0 and counts["X-03"] == -1
        with pytest.raises(ValueError):
            register_rule(Rule(id="R-01", descripcion="", categoria="x", sql="SELECT 1"))
    finally:
        for rule_id in ("X-01", "X-02", "X-03"):
            unregister_rule(rule_id)


def test_no_rule_selected(tables):
    summary = run_rules(tables, categorias=["ninguna"])
    assert (summary.total, summary.por_regla) == (0, [])


def test_one_rule_stamped(tables):
    (rule,) = by_id("R-14")
    found = run_rule(tables, rule, "2024-01-01T00:00:00")
    assert found.columns == VIOLATION.names
    assert {r.fecha_validacion for r in found.select("fecha_validacion").distinct().collect()} == {"2024-01-01T00:00:00"}


def test_sink_replaces_only_what_was_run(spark, tables, tmp_path):
    path = str(tmp_path / "violaciones")
    first = run_rules(tables, categorias=["registral", "duplicados", "terreno"], output=path)
    stored = read_violations(spark, path)
    assert stored.count() == first.total > 0
    assert stored.columns == VIOLATION.names
    # A second run of one severity leaves everything else in place.
    before = {(r.categoria, r.severidad): r["count"] for r in stored.groupBy("categoria", "severidad").count().collect()}
    clean = Cadastre(spark, tables.given | {"cca_predio": tables.given["cca_predio"].filter("folio_matricula is null")})
    again = run_rules(clean, categorias=["duplicados"], severidades=["advertencia"], output=path)
    assert again.total == 0
    after = {(r.categoria, r.severidad): r["count"]
             for r in read_violations(spark, path).groupBy("categoria", "severidad").count().collect()}
    before.pop(("duplicados", "advertencia"))
    assert after == before


def test_tables_from_files(spark, tables, tmp_path):
    tables.frames["cca_terreno"].write.json(str(tmp_path / "cca_terreno"))
    loaded = load_tables(spark, str(tmp_path), format="json")
    assert loaded.has("terreno") and not loaded.has("predio")
    assert loaded["terreno"].schema["predio"].dataType.simpleString() == "bigint"
    assert loaded["terreno"].count() == tables["terreno"].count()
    assert len(select_rules(["terreno"])) == 2


# ------------------------------------------------------------------ commit log and resumable runs


def counts(summary):
    return {rule_id: n for rule_id, _, _, n in summary.por_regla}


def test_a_killed_frame_takes_only_its_rules_along(spark, tables, tmp_path):
    from linderos.plans.run import cancel_frame

    path, seen = str(tmp_path / "v"), []

    def kill(run, frame):
        seen.append(frame)
        if frame == "folio_repetido":
            cancel_frame(spark, run, frame)

    whole = run_rules(tables, categorias=["duplicados", "registral"], output=str(tmp_path / "w"))
    cut = run_rules(tables, categorias=["duplicados", "registral"], output=path, on_frame=kill)
    assert cut.inconclusas == ("R-18",) and counts(cut) == counts(whole) | {"R-18": -1} and "R-18" in cut.fallos
    assert sorted(seen) == ["folio_repetido", "numero_repetido", "predio"]
    seen.clear()
    again = run_rules(tables, categorias=["duplicados", "registral"], output=path, resume=cut.corrida, on_frame=lambda run, frame: seen.append(frame))
    assert seen == ["folio_repetido"] and counts(again) == counts(whole) and again.corrida == cut.corrida
    assert read_violations(spark, path).count() == whole.total


def test_rules_that_were_not_finished_keep_earlier_rows(spark, tables, tmp_path):
    from linderos.plans.run import cancel_frame

    path = str(tmp_path / "v")
    first = run_rules(tables, categorias=["duplicados"], output=path)
    clean = Cadastre(spark, tables.given | {"cca_predio": tables.given["cca_predio"].limit(0)})
    kill = lambda run, frame: cancel_frame(spark, run, frame) if frame == "folio_repetido" else None
    run_rules(clean, categorias=["duplicados"], output=path, on_frame=kill)
    left = {r["regla_id"]: r["count"] for r in read_violations(spark, path).groupBy("regla_id").count().collect()}
    assert left == {"R-18": counts(first)["R-18"]}
    assert read_violations(spark, path, version=1).count() == first.total


def test_a_run_that_dies_leaves_frames_to_resume_from(spark, tables, tmp_path, monkeypatch):
    from linderos.plans import run as runs

    path, started = str(tmp_path / "v"), []

    def die(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(runs, "commit", die)
    with pytest.raises(KeyboardInterrupt):
        run_rules(tables, categorias=["duplicados"], output=path, on_frame=lambda run, frame: started.append((run, frame)))
    monkeypatch.undo()
    assert read_violations(spark, path).count() == 0 and len(started) == 2
    again = run_rules(tables, categorias=["duplicados"], output=path, resume=started[0][0].split('/')[0], on_frame=lambda run, frame: started.append((run, frame)))
    assert len(started) == 2 and again.total == read_violations(spark, path).count() > 0


def test_runs_that_start_together(spark, tables, tmp_path):
    """Over one pair the second commit is refused and can be rebased; over different pairs both count; stamps differ."""
    from linderos.plans import sink

    path = str(tmp_path / "v")
    rows = spark.createDataFrame([("R-17", "d", "duplicados", "error", "t", 1, None, None, None, None, "")], VIOLATION)
    one, two, three = (sink.begin(spark, path) for _ in range(3))
    for writing in (one, two):
        sink.write_part(spark, writing, rows, ["R-17"])
    assert sink.commit(spark, two, [("R-17", "duplicados", "error")]) == 1
    with pytest.raises(sink.ConcurrentWrite):
        sink.commit(spark, one, [("R-17", "duplicados", "error")])
    assert sink.commit(spark, three, [("R-25-A", "terreno", "error")]) == 2
    assert sink.commit(spark, sink.rebased(spark, one), [("R-17", "duplicados", "error")]) == 3
    assert [c.run for c in sink.commits(spark, path)] == [two.run, three.run, one.run]
    assert sink.begin(spark, path).when > one.when
    assert [read_violations(spark, path, version=v).count() for v in (0, 1, 2, 3)] == [0, 1, 1, 1]


def test_a_number_is_given_once(spark, tmp_path):
    """Many commits at a time over different pairs: each gets a number, none is lost."""
    from concurrent.futures import ThreadPoolExecutor

    from linderos.plans import sink

    path = str(tmp_path / "v")
    writings = [sink.begin(spark, path) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda k: sink.commit(spark, writings[k], [(f"X-{k}", f"c{k}", "error")]), range(8)))
    assert sorted(versions) == list(range(1, 9)) and len(sink.snapshot(spark, path).cells) == 8
    assert not sink.create_once(spark, f"{path}/log/{1:020d}.json", "x") and len(sink.commits(spark, path)) == 8


def test_compaction_in_place_and_removal(spark, tables, tmp_path):
    from linderos.plans import sink

    path = str(tmp_path / "v")
    for _ in range(2):
        total = run_rules(tables, categorias=["duplicados", "registral"], output=path).total
    before = bag(read_violations(spark, path).collect())
    running = sink.begin(spark, path)
    part = sink.write_part(spark, running, read_violations(spark, path), ["R-17"])
    sink.compact(spark, path)
    assert bag(read_violations(spark, path).collect()) == before and len(sink.snapshot(spark, path).parts()) == 1
    gone = sink.vacuum(spark, path, running=[running.run])
    assert len(gone) == 6 and part not in gone and bag(read_violations(spark, path).collect()) == before and total == len(before)
    assert sink.vacuum(spark, path) == [part]


def test_a_commit_being_written_is_not_seen(spark, tables, tmp_path):
    from linderos.plans import sink

    path = str(tmp_path / "v")
    total = run_rules(tables, categorias=["duplicados"], output=path).total
    (tmp_path / "v" / "log" / f"{2:020d}.json").write_text('{"version": 2, "ru')
    assert read_violations(spark, path).count() == total
    run_rules(tables, categorias=["duplicados"], output=path)
    assert [c.version for c in sink.commits(spark, path)] == [1, 3]


# ------------------------------------------------------------------ registry list in ranges


def csv_reference(path, name="numero_predial"):
    import csv

    with open(path, encoding="utf-8-sig", newline="") as lines:
        return sorted((row[name] or "").strip().replace("\r\n", "\n") for row in csv.DictReader(lines) if (row[name] or "").strip())


@pytest.mark.parametrize("size", [7, 40, 333, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges_that_begin_inside_fields(spark, tmp_path, size, end):
    import csv
    import random

    rng = random.Random(size)
    path = tmp_path / "r1.csv"
    pieces = ["a", '"', '""', ",", "\n", "\n\n", "é", " ", "x\ny", '",', ',"', "12"]
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("﻿")
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["obs\nvarias", "numero_predial", "más"])
        for k in range(400):
            texts = ["".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(2)]
            writer.writerow([texts[0], f" {k}{texts[1]} ", "" if k % 3 else "fin\n"])
        out.write(f'suelto"con comillas,77{end}"mal" cerrado,78,z{end}{end}corto{end}ultimo,"79')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        loaded = read_r1_csv(spark, str(path))
        assert sorted(r[0] for r in loaded.rows.collect()) == csv_reference(path)
        if size < 1000:
            ranges = spark.read.text(str(path)).rdd.getNumPartitions()
            assert ranges > path.stat().st_size / size / 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_files_of_a_folder_have_a_header_each(spark, tmp_path):
    folder = tmp_path / "r1"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f'numero_predial,obs\n{k},"a\nb"\n\n{k + 10},c\n', encoding="utf-8")
    (folder / "empty.csv").write_text("", encoding="utf-8")
    assert bag(read_r1_csv(spark, str(folder)).rows.collect()) == bag([(str(n),) for n in (0, 1, 2, 10, 11, 12)])


def test_parameters_are_bound_as_values(spark, tables):
    odd = "O'Brien \\ \"x\" {0} ; --"
    given = Cadastre(spark, tables.given | {"cca_direccion": spark.createDataFrame([(1, odd), (2, "b")], "T_Id long, via string")})
    sql = "SELECT 'cca_direccion', T_Id, NULL, 'm{0}', via, :n FROM cca_direccion WHERE via = :texto AND via RLIKE '[a-zA-Z]{2}' AND '12:00' <> via"
    rules = [Rule(id="X-1", descripcion="", categoria="u", sql=sql, parametros={"texto": odd, "n": 3, "unused": None})]
    summary = run_rules(given, rules=rules)
    assert [(r.t_id, r.valor_actual, r.valor_esperado) for r in summary.violaciones.collect()] == [(1, odd, "3")]


def test_parts_are_written_from_small_partitions(spark, tmp_path, monkeypatch):
    """A task that sorts or groups shuffled rows holds far more than their compressed bytes."""
    from linderos import session

    key, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        with session.configured(spark):
            seen.append(spark.conf.get(key))
        assert seen == ["16m"]
    finally:
        spark.conf.set(key, before)
