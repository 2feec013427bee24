"""Hand-made frames for the rules that random tables rarely reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import tsql
from fleetlens.functions.ordering import positions, running_totals
from fleetlens.operators import catalog, history, maintenance, packages, security, selection, storage, topology, trace, workload
from fleetlens.sources import sinks, snapshots


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- helpers ---------------------------------------------------------------------


def test_boundaries_count_crossings_not_full_units(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 10:00:59' a, timestamp_ntz'2024-01-01 10:01:00' b")
    assert df.select(tsql.boundaries("MINUTE", "a", "b")).first()[0] == 1


def test_boundaries_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'1996-04-07 01:30:00' a, timestamp_ntz'1996-04-07 02:45:10' b")
        got = df.select(*[tsql.boundaries(u, "a", "b") for u in ("DAY", "HOUR", "MINUTE", "SECOND")], tsql.clock_text("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (0, 1, 75, 4510, "02:45:10")


def test_int_div_truncates_toward_zero_and_guards_zero(spark):
    df = spark.createDataFrame([(-7, 2), (7, 0)], "a int, b int")
    assert [r[0] for r in df.select(tsql.int_div("a", "b")).collect()] == [-3, None]
    assert [r[0] for r in df.select(tsql.guarded_div("a", "b")).collect()] == [-3, 0]


@pytest.mark.parametrize("clock,text,quirk", [
    (0, "12:00 AM", "12:00 AM"), (905, "12:09 AM", "12:09 AM"), (93000, "9:30 AM", "9:30 AM"), (110000, "11:00 AM", "11:00 AM"),
    (120500, "12:05 PM", "0:05 PM"), (130000, "1:00 PM", "1:00 PM"), (235900, "11:59 PM", "11:59 PM"),
])
def test_clock(spark, clock, text, quirk):
    df = spark.createDataFrame([(clock,)], "c int")
    assert df.select(tsql.clock_12h("c"), tsql.clock_12h("c", quirk=True)).first() == (text, quirk)


def test_quote_doubles_closing_mark(spark):
    assert spark.createDataFrame([("a]b",)], "n string").select(tsql.quote("n")).first()[0] == "[a]]b]"


def test_duration_text(spark):
    df = spark.createDataFrame([(59,), (3661,), (90061,)], "s long")
    assert [r[0] for r in df.select(tsql.duration_text("s")).collect()] == ["00:00:59", "01:01:01", "1.01:01:01"]


# --- running totals ---------------------------------------------------------------


def test_running_totals_match_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 40}", i, rnd.randint(0, 5)) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, id long, v long").repartition(5)
    out = running_totals(df, ["k"], [F.col("v").desc(), F.col("id")], F.col("v"), slices=6)
    expected = []
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (-r[2], r[1]))
        before = 0
        for n, r in enumerate(group, 1):
            expected.append((key, r[1], n, before, sum(x[2] for x in group)))
            before += r[2]
    assert rows(out, "k", "id", "position", "sum_before", "sum_total") == sorted(expected, key=repr)


def test_positions_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert rows(positions(df, [], [F.col("x").desc()]), "x", "position") == sorted(((x, 1000 - x) for x in range(1000)), key=repr)


# --- waits ------------------------------------------------------------------------


def test_pareto_keeps_rows_until_the_share_before_reaches_the_cut(spark):
    waits = spark.createDataFrame(
        [("A", 900, 100, 1), ("B", 50, 0, 2), ("C", 25, 5, 1), ("D", 25, 0, 1), ("E", 10, 0, 0), ("WAITFOR", 10**6, 0, 9)],
        "wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long",
    )
    # shares before: A 0, B 90, C 95 -> C is out; E has no tasks; WAITFOR is benign
    assert [r[0] for r in rows(workload.wait_pareto(waits), "wait_type")] == ["A", "B"]
    assert [r[0] for r in rows(workload.wait_pareto(waits, threshold=96), "wait_type")] == ["A", "B", "C"]
    assert len(workload.BENIGN_WAITS) == len(set(workload.BENIGN_WAITS)) == 80


def test_latch_without_waits_has_no_average(spark):
    latches = spark.createDataFrame([("L", 10, 0), ("BUFFER", 99, 1)], "latch_class string, wait_time_ms long, waiting_requests_count long")
    assert rows(workload.latch_pareto(latches), "latch_class", "avg_wait_s") == [("L", None)]


def test_pareto_per_server(spark):
    waits = spark.createDataFrame(
        [("s1", "A", 100, 0, 1), ("s2", "A", 1, 0, 1), ("s2", "B", 99, 0, 1)],
        "server_name string, wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long",
    )
    assert rows(workload.wait_pareto(waits), "server_name", "wait_type") == [("s1", "A"), ("s2", "B")]


def test_head_blockers_per_server_takes_the_longest(spark):
    req = spark.createDataFrame(
        [("s1", 1, 0, 50, 1), ("s1", 2, 1, 5, 1), ("s1", 3, 0, 90, 1), ("s1", 4, 3, 5, 1), ("s2", 1, 0, 7, 1), ("s2", 9, 0, 99, 1)],
        "server_name string, session_id long, blocking_session_id long, total_elapsed_time long, sql_handle long",
    )
    text = spark.createDataFrame([(1, "x")], "sql_handle long, text string")
    assert rows(workload.head_blockers(req, text, top=1), "server_name", "session_id") == [("s1", 3)]


def test_statement_text_cuts_by_byte_offsets(spark):
    df = spark.createDataFrame([("select 1\nselect 2", 18, -1), ("select 1\nselect 2", 0, 14)], "text string, s int, e int")
    assert [r[0] for r in df.select(catalog.statement_text("text", "s", "e")).collect()] == ["select 2", "select 1"]


def test_error_log_drops_unknown_description(spark):
    log = spark.createDataFrame([("d", None), ("d", "x Connected"), ("d", "boom"), ("e", "boom")], "database_name string, description string")
    assert rows(workload.error_log_filter(log, "d"), "description") == [("boom",)]


def test_resource_quota_counts_cores_per_server(spark):
    gov = spark.createDataFrame([("s1", 2047), ("s2", 100)], "server_name string, user_data_directory_space_quota_mb long")
    sched = spark.createDataFrame([("s1", "VISIBLE ONLINE"), ("s1", "VISIBLE ONLINE"), ("s1", "HIDDEN ONLINE")], "server_name string, status string")
    assert rows(workload.resource_quota(gov, sched), "server_name", "max_storage_gb", "v_cores") == [("s1", 1, 2), ("s2", 0, 0)]


# --- history ----------------------------------------------------------------------

SCHED = ("job_id long, schedule_id long, name string, enabled int, freq_type int, freq_interval int, freq_recurrence_factor int, "
         "freq_subday_type int, freq_subday_interval int, freq_relative_interval int, active_start_date int, active_end_date int, "
         "active_start_time int, active_end_time int")


@pytest.mark.parametrize("fields,expected", [
    ((1, 0, 0, 1, 0, 0), "Once on 2024.03.05 at 1:05 PM"),
    ((4, 1, 1, 1, 0, 0), "Daily at 1:05 PM"),
    ((4, 1, 1, 4, 1, 0), "Daily every 1 minute between 1:05 PM and 11:30 PM"),
    ((8, 65, 1, 8, 2, 0), "Weekly on Sunday, Saturday every 2 hours between 1:05 PM and 11:30 PM"),
    ((8, 2, 3, 2, 30, 0), "Every 3 weeks on Monday every 30 seconds between 1:05 PM and 11:30 PM"),
    ((16, 22, 1, 1, 0, 0), "Monthly on the 22nd at 1:05 PM"),
    ((16, 11, 2, 1, 0, 0), "Every 2 months on the 11th at 1:05 PM"),
    ((32, 9, 1, 1, 0, 16), "Monthly on the last week day at 1:05 PM"),
    ((64, 0, 0, 0, 0, 0), "Automatically starts when SQLServerAgent starts."),
    ((128, 0, 0, 0, 0, 0), "Starts whenever the CPUs become idle"),
    ((99, 0, 0, 0, 0, 0), ""),
])
def test_schedule_texts(spark, fields, expected):
    kind, interval, factor, sub, every, relative = fields
    jobs = spark.createDataFrame([(1, "j", 1, 1, 0)], "job_id long, name string, owner_sid int, enabled int, category_id int")
    sched = spark.createDataFrame(
        [(1, 1, "s", 1, kind, interval, factor, sub, every, relative, 20240305, 99991231, 130500, 233000)], SCHED
    )
    logins = spark.createDataFrame([(1, "sa")], "sid int, name string")
    got = history.schedule_description(jobs, sched, logins, own_prefix="own").first()
    assert (got["schedule"], got["start_date"], got["end_date"], got["job_owner"]) == (expected, "05/03/2024 1:05 PM", "No end date", "sa")


def test_schedule_of_disabled_unscheduled_and_excluded_jobs(spark):
    jobs = spark.createDataFrame(
        [(1, "off", 1, 0, 0), (2, "free", 1, 1, 0), (3, "own x", 1, 1, 0), (4, "syspolicy_purge_history", 1, 1, 0), (5, "report", 1, 1, 100)],
        "job_id long, name string, owner_sid int, enabled int, category_id int",
    )
    sched = spark.createDataFrame([(1, 1, "s", 1, 4, 1, 1, 1, 0, 0, 20240305, 99991231, 0, 0)], SCHED)
    logins = spark.createDataFrame([(9, "sa")], "sid int, name string")
    assert rows(history.schedule_description(jobs, sched, logins, own_prefix="own"), "job_name", "schedule") == [("free", "Unscheduled"), ("off", "Job is disabled")]


def test_shared_schedule_through_link(spark):
    jobs = spark.createDataFrame([(1, "a", 1, 1, 0), (2, "b", 1, 1, 0)], "job_id long, name string, owner_sid int, enabled int, category_id int")
    sched = spark.createDataFrame([(0, 5, "s", 0, 4, 1, 1, 1, 0, 0, 20240305, 20241231, 0, 0)], SCHED).drop("job_id")
    links = spark.createDataFrame([(1, 5), (2, 5)], "job_id long, schedule_id long")
    logins = spark.createDataFrame([(1, "sa")], "sid int, name string")
    got = history.schedule_description(jobs, sched, logins, links)
    assert rows(got, "job_name", "schedule_state", "end_date") == [("a", "Disabled", "31/12/2024 12:00 AM"), ("b", "Disabled", "31/12/2024 12:00 AM")]


def test_backup_type_codes_have_an_else_branch(spark):
    t0 = dt.datetime(2024, 1, 1)
    bk = spark.createDataFrame(
        [(n, "db", c, t0, t0, 5 << 20) for n, c in enumerate("DLIFGPQX")] + [(99, "MSDB", "D", t0, t0, 1)],
        "media_set_id long, database_name string, type string, backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, backup_size long",
    )
    media = bk.select("media_set_id").union(bk.select("media_set_id"))
    got = history.backup_history(bk, media)
    assert got.count() == 8 and {r["backup_type"] for r in got.collect()} == {*history.BACKUP_TYPES.values(), "Unknown"}
    assert {r["size_text"] for r in got.collect()} == {"5 MB"}


def test_log_backups_without_cover_are_kept(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    bk = spark.createDataFrame(
        [("a", "D", day(5), 0, 1), ("a", "L", day(4), 0, 2), ("a", "L", day(6), 0, 3), ("b", "L", day(1), 0, 4), ("c", "D", day(3), 1, 5), ("c", "L", day(1), 0, 6)],
        "database_name string, type string, backup_start_date timestamp_ntz, is_damaged int, last_lsn long",
    )
    got = history.purgeable_log_backups(bk, as_of="2024-01-20 00:00:00")
    assert rows(got, "database_name", "last_lsn") == [("a", 2)]


def test_times_of_day_repeat_equal_times(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 30)
    bk = spark.createDataFrame([("d", "L", t0), ("d", "L", t0), ("d", "L", t0.replace(hour=7))], "database_name string, type string, backup_start_date timestamp_ntz")
    assert history.backup_times_of_day(bk).first()["times"] == "Times: 07:30:00 | 08:30:00 | 08:30:00 | "


# --- storage ----------------------------------------------------------------------


def test_growth_words(spark):
    files = spark.createDataFrame([(0, 1, -1), (10, 1, -1), (10, 1, 2560), (1280, 0, -1), (1280, 0, 2560)], "growth int, is_percent_growth int, max_size int")
    assert [r["autogrow"] for r in storage.growth_setting_text(files).collect()] == [
        "N/A", "10 percent unrestricted", "10 percent max of 20 mb", "10 mb unrestricted", "10 mb max of 20 mb",
    ]


def test_empty_bucket_still_gives_a_row(spark):
    plans = spark.createDataFrame([(5, 1, 1 << 20)], "usecounts int, refcounts int, size_in_bytes int")
    assert rows(storage.plan_cache_reuse(plans), "bucket", "plan_count", "size_mb") == [("More_than_two", 1, 1), ("One_call", 0, None), ("Two_calls", 0, None)]


def test_resource_database_has_its_own_name(spark):
    desc = spark.createDataFrame([(32767, 0), (1, 0)], "database_id int, free_space_in_bytes int")
    names = spark.createDataFrame([(1, "a")], "database_id int, name string")
    assert rows(storage.buffer_pool_by_database(desc, names), "database") == [("Resource Database",), ("a",)]


def test_fragmentation_given_as_text_is_compared_as_number(spark):
    detail = spark.createDataFrame([("9.5", "1000"), ("100", "101"), ("60", "100"), ("bad", "500")], "avg_fragmentation_in_percent string, page_count string")
    assert rows(storage.index_fragmentation_alert(detail), "avg_fragmentation_in_percent") == [("100",)]


def test_showplan_with_two_statements_and_namespace(spark):
    group = ('<MissingIndexes><MissingIndexGroup Impact="81.5"><MissingIndex Database="[d]" Schema="[s]" Table="[t]">'
             '<ColumnGroup Usage="INEQUALITY"><Column Name="[b]"/></ColumnGroup><ColumnGroup Usage="INCLUDE"><Column Name="[@x]"/></ColumnGroup>'
             "</MissingIndex></MissingIndexGroup></MissingIndexes>")
    plan = ('<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><BatchSequence><Batch><Statements>'
            f'<StmtSimple StatementText="one"><QueryPlan CachedPlanSize="16">{group}</QueryPlan></StmtSimple>'
            '<StmtSimple StatementText="two"><QueryPlan CachedPlanSize="16"/></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>')
    plans = spark.createDataFrame([(1, plan), (2, plan.replace(group, ""))], "plan_handle long, query_plan string")
    stats = spark.createDataFrame([(1, 1500), (2, 1)], "plan_handle long, total_worker_time long")
    got = storage.missing_index_from_plans(stats, plans, 3).collect()
    assert len(got) == 1
    assert got[0]["missing_index_creation"] == "CREATE NONCLUSTERED INDEX [IX_b_@x] ON [d].[s].[t]([b]) INCLUDE ([x]) WITH (ONLINE = ON);"
    assert float(got[0]["total_worker_time_ms"]) == 1.5 and got[0]["impact_pct"] == 81.5


# --- maintenance ---------------------------------------------------------------------


def test_null_column_makes_a_database_not_eligible(spark):
    cols = ("name string, current_backup_type string, state_desc string, user_access string, in_standby int, recovery_model_desc string, log_lsn long, "
            "differential_base_lsn long, availability_group string, availability_group_role string, is_preferred_backup_replica int, log_shipping_role string, is_read_only int")
    base = ["a", "FULL", "ONLINE", "MULTI_USER", 0, "FULL", 1, 1, None, None, None, None, 0]
    unknown = ["b", *base[1:4], None, *base[5:]]
    offline = ["c", "FULL", "OFFLINE", *base[3:]]
    secondary = ["d", *base[1:8], "ag", "SECONDARY", 1, None, 0]
    got = maintenance.backup_eligibility(spark.createDataFrame([tuple(r) for r in (base, unknown, offline, secondary)], cols))
    assert rows(got, "name", "eligible") == [("a", True), ("b", False), ("c", False), ("d", False)]
    assert [r[0] for r in got.filter("name = 'b'").select("allow_standby").collect()] == [None]


def test_page_locks_off_rebuilds_with_one_core(spark):
    work = spark.createDataFrame(
        [("a", 40, 2000, 1, 0), ("b", 10, 2000, 1, 0), ("c", 3, 2000, 1, 1), ("d", 40, 10, 1, 1), ("e", 30, 1000, 3, 1)],
        "index_name string, avg_fragmentation_in_percent int, page_count int, index_type int, allow_page_locks int",
    )
    got = rows(maintenance.index_maintenance_plan(work), "index_name", "fragmentation_group", "action", "max_dop")
    assert got == [
        ("a", "High", "INDEX_REBUILD_ONLINE", 1), ("b", "Medium", "INDEX_REBUILD_ONLINE", 1), ("c", "Low", None, None),
        ("d", "High", None, None), ("e", "High", "INDEX_REBUILD_OFFLINE", None),
    ]


def test_unknown_order_is_refused(spark):
    with pytest.raises(ValueError):
        maintenance.work_order(spark.range(1), "SIZE_UP")


# --- selection -----------------------------------------------------------------------


@pytest.mark.parametrize("text,expected", [
    ("ALL_DATABASES", {"master", "a_b", "axb", "[odd]", "Sales"}),
    ("SYSTEM_DATABASES", {"master"}),
    ("USER_DATABASES, -Sales", {"a_b", "axb", "[odd]"}),
    ("a_b", {"a_b"}),
    ("a%, -axb", {"a_b", "axb"} - {"axb"}),
    ("-axb, a%", {"a_b"}),
    ("SALES", {"Sales"}),
    ("[[odd]]]", {"[odd]"}),
    ("-%", set()),
    ("a%,\r\n Sales", {"a_b", "axb", "Sales"}),
])
def test_selection_grammar(spark, text, expected):
    items = spark.createDataFrame([(n,) for n in ("master", "tempdb", "a_b", "axb", "[odd]", "Sales")], "name string")
    assert {r["name"] for r in selection.select_by_patterns(items, text).collect()} == expected


def test_empty_entry_is_refused():
    with pytest.raises(ValueError):
        selection.split_list("a,,b")


def test_dotted_names_with_brackets():
    assert selection.name_parts("db.[my.schema].[t]]x].ix") == ["db", "my.schema", "t]x", "ix"]


# --- security ------------------------------------------------------------------------

CUSTOMERS = [("John1", "A", "User1"), ("Fred", "B", "User2"), ("Mark", "A", "BOSS"), ("Alfred", "B", "BOSS")]


def test_row_rule_for_owner_and_supervisor(spark, tmp_path):
    df = spark.createDataFrame(CUSTOMERS, "customer string, status string, userlead string")
    assert rows(security.row_level_filter(df, "User1"), "customer") == [("John1",)]
    assert rows(security.row_level_filter(df, "BOSS"), "customer") == [("Alfred",), ("John1",), ("Mark",)]
    path = str(tmp_path / "t")
    security.row_level_append(spark.createDataFrame([("aaa", "A", "User1")], df.schema), path, "BOSS")
    with pytest.raises(PermissionError):
        security.row_level_append(spark.createDataFrame([("ok", "A", "x"), ("bbb", "B", "User1")], df.schema), path, "BOSS")
    assert rows(spark.read.parquet(path), "customer") == [("aaa",)]


def test_ledger_update_is_delete_then_insert(spark):
    log = spark.createDataFrame(
        [(1, 10, 0, "INSERT", "a"), (1, 11, 0, "INSERT", "b"), (1, 11, 0, "DELETE", "a"), (2, 10, 1, "INSERT", "x"), (2, 12, 0, "DELETE", "x")],
        "k int, transaction_id int, sequence_number int, op string, v string",
    )
    assert rows(security.ledger_current(log), "k", "v") == [(1, "b")]
    assert security.ledger_history(log, op="DELETE").count() == 2


def test_platform_of_editions(spark):
    props = spark.createDataFrame([("16.0.1000.6", "SQL Azure", 8), ("15.3.1", "Standard", 4), ("15.0.1", "Standard", 3)], "product_version string, edition string, engine_edition int")
    assert [tuple(r) for r in security.server_version_parse(props).select("major_version", "minor_version", "platform").collect()] == [
        (16, 0, "SQL Azure - Managed Instance"), (15, 3, "SQL on Docker"), (15, 0, ""),
    ]


def test_affinity_masks(spark):
    config = spark.createDataFrame([(1, 4, 0, 0), (2, 16, 0b1011, 0), (3, 40, -1, 0b11), (4, 64, 0, 0)], "server_id int, cores int, affinity_mask int, affinity64_mask int")
    files = spark.createDataFrame([(1, 1024), (2, 1024), (2, 2048)], "server_id int, size_pages int")
    got = security.tempdb_file_advice(config, files, server="server_id")
    assert rows(got, "server_id", "usable_cores", "recommended_files", "missing_files", "size_mismatch") == [
        (1, 4, 4, 3, 0), (2, 3, 3, 1, 1), (3, 34, 8, 8, 0), (4, 64, 8, 8, 0),
    ]


# --- packages, traces, topology ----------------------------------------------------------


def test_command_forms(spark):
    commands = [
        r'/ISSERVER "\"\SSISDB\Fin\Load\Daily.dtsx\"" /SERVER "\"srv1\inst\"" /ENVREFERENCE 12 /Par "\"p\"";1 /Par "\"$ServerOption::LOGGING_LEVEL(Int16)\"";1',
        r'/FILE "\"D:\ssis\sub\One.dtsx\"" /X86 /CHECKPOINTING OFF',
        r'/Server "srv2" /SQL "Maintenance Plans\Full" /set "\Package\Sub_1.Disable;false"',
    ]
    df = spark.createDataFrame([(c, "SSIS") for c in commands] + [(commands[0], "TSQL")], "command string, subsystem string")
    parsed = df.withColumns(packages.parse_command()).select("folder", "project", "package", "environment_reference", "is_32bit", "changed_parameters").collect()
    assert [tuple(r) for r in parsed] == [
        ("Fin", "Load", "Daily.dtsx", 12, "", '"\\"p\\"";1 '), ("D:\\ssis\\sub\\", "", "One.dtsx", None, "Yes", ""),
        ("Maintenance Plans\\Full", "", "\\Package\\Sub_1.Disable;false", None, "", ""), ("", "", "", None, "", ""),
    ]


def test_restart_properties_by_position(spark):
    ev = spark.createDataFrame([(1074, dt.datetime(2024, 1, 1), ["p", "h", "r", "0x1", "restart", "c", "u"]), (1, dt.datetime(2024, 1, 1), [])],
                               "event_id int, time_created timestamp_ntz, properties array<string>")
    assert rows(trace.host_restart_events(ev), "user", "process", "action", "reason", "reason_code", "comment") == [("u", "p", "restart", "r", "0x1", "c")]


def test_undelivered_counts_only_later_commands(spark):
    hist = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1)), (1, 7, dt.datetime(2024, 1, 2)), (2, 0, dt.datetime(2024, 1, 1)), (3, None, dt.datetime(2024, 1, 1))],
                                 "agent_id long, xact_seqno long, time timestamp_ntz")
    cmds = spark.createDataFrame([(7, 1), (8, 1), (8, 1), (9, 2)], "xact_seqno long, article_id long")
    subs = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "agent_id long, article_id long")
    assert rows(topology.undelivered_commands(hist, cmds, subs), "agent_id", "undelivered") == [(1, 2), (2, 4)]


# --- sources and sinks ------------------------------------------------------------------


def test_fleet_union_fills_missing_columns_and_drops_system(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "n")], "x int, y string")
    got = snapshots.fleet_union([("s", "d1", a), ("s", "d2", b), ("s", "MASTER", b)])
    assert rows(got, "database_name", "x", "y") == [("d1", 1, None), ("d2", 2, "n")]


def test_snapshot_scan_prunes_partitions_and_columns(spark, tmp_path):
    df = spark.createDataFrame([("s1", "2024-01-01", 1, "a"), ("s2", "2024-01-02", 2, "b")], "server_name string, snapshot_date string, x int, y string")
    df.write.partitionBy("server_name", "snapshot_date").parquet(str(tmp_path / "t"))
    got = snapshots.snapshot_scan(spark, str(tmp_path), "t", server="s2", since="2024-01-02", columns=["x"])
    assert rows(got, "x") == [(2,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(server_name" in plan and "ReadSchema: struct<x:int>" in plan


def test_bulk_append_limits_rows_per_file(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.bulk_append(spark.range(250).coalesce(1), path, batch_rows=100)
    sinks.bulk_append(spark.range(10).coalesce(1), path, batch_rows=100)
    assert spark.read.parquet(path).count() == 260
    assert max(r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()) == 100


def test_report_batch_logs_a_failing_report(spark, tmp_path):
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    log = sinks.report_batch(spark, {"good": spark.range(3), "bad": bad, "xml": spark.range(2)}, str(tmp_path / "o"), {"xml": "xml"})
    assert rows(log, "report", "outcome") == [("bad", "Failed"), ("good", "Succeeded"), ("xml", "Succeeded")]
    assert spark.read.parquet(str(tmp_path / "o" / "_run_log")).count() == 3


def test_retention_rewrite_drops_old_days_and_trims_the_edge(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS hist")
    data = [(dt.datetime(2024, 1, d, h), dt.date(2024, 1, d), d * 100 + h) for d in (1, 2, 3) for h in (6, 18)]
    spark.createDataFrame(data, "ts timestamp_ntz, day date, id int").select("ts", "id", "day").write.partitionBy("day").option(
        "path", str(tmp_path / "hist")).saveAsTable("hist")
    sinks.retention_rewrite(spark, "hist", "ts", "day", "2024-02-13 12:00:00", keep_days=42)
    assert rows(spark.table("hist"), "id") == [(218,), (306,), (318,)]
    spark.sql("DROP TABLE hist")


def test_named_listings_are_complete(spark):
    assert len(catalog.LISTINGS) == 15
    users = spark.createDataFrame([("s", "u", "S", "SQL_USER", "INSTANCE", b"1"), ("s", "r", "R", "ROLE", "NONE", b"2")],
                                  "server_name string, name string, type string, type_desc string, authentication_type_desc string, sid binary")
    assert rows(catalog.named_listing("database_user_list", users), "server_name", "name") == [("s", "u")]


def test_configuration_overview(spark):
    kv = spark.createDataFrame(
        [("s1", "max degree of parallelism", 4), ("s1", "remote admin connections", 1), ("s1", "other", 9), ("s2", "backup compression default", 0)],
        "server_name string, name string, value_in_use long",
    )
    sizes = spark.createDataFrame([("s1", "8"), ("s1", "8"), ("s1", "12")], "server_name string, value string")
    got = security.config_wide(kv, lists={"tempdb_mb": sizes})
    assert rows(got, "server_name", "max_degree_of_parallelism", "remote_admin_connections", "backup_compression_default", "tempdb_mb") == [
        ("s1", 4, "Enabled", "No", "12, 8, 8"), ("s2", None, "Disabled", "No", None),
    ]


@pytest.mark.parametrize("include,exclude", [("a%", "%1"), ("%2,b%", "a%"), ("ALL_DATABASES", "b2")])
def test_exclusion_only_removes(spark, include, exclude):
    items = spark.createDataFrame([(f"{c}{n}",) for c in "abc" for n in range(4)], "name string")
    names = lambda text: {r["name"] for r in selection.select_by_patterns(items, text).collect()}
    excluded = ",".join(f"-{e}" for e in exclude.split(","))
    assert names(f"{include},{excluded}") == names(include) - names(exclude)


def test_large_counters_do_not_overflow(spark):
    stats = spark.createDataFrame(
        [(1, 1, 1, 5_000_000_000, 8_000_000_000_000_000, "x"), (2, 1, 1, 1000, 8_000_000_000_000_000, "x")],
        "statistics_id int, index_id int, index_type int, modification_counter long, row_count long, action string",
    )
    got = maintenance.statistics_update_plan(stats, modification_level=50)
    assert rows(got, "statistics_id", "update_statistics") == [(1, "Y"), (2, "N")]


def test_update_mode_is_refused(spark):
    from fleetlens.streaming.operators import run_to_table

    with pytest.raises(ValueError):
        run_to_table(spark.range(1), mode="update")


def test_partly_tagged_frames_are_refused(spark):
    from fleetlens.functions.fleet import DATABASE, shared_keys, with_database_name

    usage = spark.createDataFrame([(1, 7)], "database_id int, object_id int")
    indexes = spark.createDataFrame([("a", 7), ("b", 7)], "database_name string, object_id int")
    with pytest.raises(ValueError):
        shared_keys(usage, indexes, scope=DATABASE)
    named = with_database_name(usage, spark.createDataFrame([(1, "a"), (2, "b")], "database_id int, name string"))
    assert shared_keys(named, indexes, scope=DATABASE) == ["database_name"]


def test_last_name_part_keeps_brackets(spark):
    from fleetlens.functions.tsql import last_name_part

    names = spark.createDataFrame([("[db].[dbo].[a.b]",), ("db.dbo.t",), ("[x].[y]]z]",), ("t",)], "n string")
    assert [r[0] for r in names.select(last_name_part("n")).collect()] == ["a.b", "t", "y]z", "t"]


def test_plans_with_gaps_are_kept(spark):
    hint = '<QueryPlan><MissingIndexes><MissingIndexGroup Impact="9"><MissingIndex\nDatabase="[d]" Schema="[s]" Table="[t]">{}</MissingIndex></MissingIndexGroup></MissingIndexes></QueryPlan>'
    group = '<ColumnGroup Usage="EQUALITY"><Column Name="[a]"/></ColumnGroup>'
    plan = (
        '<ShowPlanXML><BatchSequence><Batch><Statements></Statements></Batch><Batch><Statements><StmtCond/></Statements>'
        f'<Statements><StmtSimple StatementText="one">{hint.format(group)}</StmtSimple></Statements></Batch>'
        f'<Batch><Statements><StmtSimple StatementText="two">{hint.format("")}</StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>'
    )
    plans = spark.createDataFrame([(1, plan)], "plan_handle int, query_plan string")
    stats = spark.sql("select 1 as plan_handle, timestamp_ntz'2024-01-01' as creation_time, 1L as execution_count, 1L as total_worker_time, 1L as last_elapsed_time")
    got = storage.missing_index_from_plans(stats, plans)
    assert sorted(r["sql_text"] for r in got.collect()) == ["one", "two"]


def test_all_key_columns_and_whole_names(spark):
    keys = spark.createDataFrame([(1, 1, n, f"c{n:02}") for n in range(1, 21)], "object_id int, index_id int, keyno int, col string")
    got = storage.index_key_pivot(keys).first()
    assert got["key_columns"] == [f"c{n:02}" for n in range(1, 21)] and got["col16"] == "c16"


def test_retention_with_server_partitions(spark, tmp_path):
    from datetime import datetime

    from fleetlens.sources.sinks import retention_rewrite

    spark.sql(
        "create table kept_history (id int, ts timestamp_ntz, server_name string, day date) using parquet"
        f" partitioned by (server_name, day) location '{tmp_path}/kept_history'"
    )
    spark.sql(
        "insert into kept_history select id, ts, s, cast(ts as date) from values (1, timestamp_ntz'2024-01-01 10:00:00', 'a'), (2, timestamp_ntz'2024-02-10 10:00:00', 'a'),"
        " (3, timestamp_ntz'2024-02-10 20:00:00', 'b'), (4, timestamp_ntz'2024-03-01 00:00:00', 'b') as t(id, ts, s)"
    )
    retention_rewrite(spark, "kept_history", "ts", "day", datetime(2024, 3, 1, 12), keep_days=20)
    assert sorted(r["id"] for r in spark.table("kept_history").collect()) == [3, 4]
    spark.sql("drop table kept_history")


def test_texts_and_plans_are_not_broadcast(spark):
    tasks = spark.createDataFrame([(1, 7, 0, 5, "CXPACKET", "nodeId=3"), (2, 8, 0, 6, "LCK", "x")], "waiting_task_address int, session_id int, exec_context_id int, wait_duration_ms int, wait_type string, resource_description string")
    os_tasks = spark.createDataFrame([(1, 4), (2, 5)], "task_address int, scheduler_id int")
    sessions = spark.createDataFrame([(7, 1), (8, 1)], "session_id int, is_user_process int")
    requests = spark.createDataFrame([(7, 1, 2, 3, 1), (8, None, 2, 3, None)], "session_id int, sql_handle int, database_id int, cpu_time int, plan_handle int")
    # sizes that the optimizer knows, and takes to be small
    texts, plans = spark.range(1, 2).selectExpr("id AS sql_handle", "concat('select ', id) AS text"), spark.range(1, 2).selectExpr("id AS plan_handle", "'<x/>' AS query_plan")
    got = workload.waits_now(tasks, os_tasks, sessions, requests, texts, plans)
    assert sorted(got.select("session_id", "node_id", "text", "query_plan").collect()) == [(7, "3", "select 1", "<x/>"), (8, None, None, None)]
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in tree and "BroadcastHashJoin" not in tree
