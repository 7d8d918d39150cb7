import pytest

from millrace.plans import frontends as Q


@pytest.mark.parametrize(
    ("text", "kind"),
    [("GET a", "redis"), ("db.users.find({})", "mongodb"), ("SELECT `a` FROM t LIMIT 1, 2", "mysql"), ("SELECT a FROM t", "postgresql"), ("SHOW TABLES", "mysql"), ("SET x = 1", "postgresql")],
)
def test_detect(text, kind):
    assert Q.detect(text) == kind


def test_mysql_text_keeps_literals():
    got = Q.from_mysql("SELECT `a` || b, 'x || LIMIT 1,2' FROM t LIMIT 5, 10")
    assert "'x || LIMIT 1,2'" in got and "LIMIT 10 OFFSET 5" in got and " OR " in got
    got = Q.from_mysql("CREATE TABLE t (e ENUM('a', 'it''s') NOT NULL, n INT UNSIGNED, d TEXT DEFAULT 'ENUM(''x'')') ENGINE=InnoDB")
    assert got == "CREATE TABLE t (e VARCHAR(50) NOT NULL, n INT, d STRING DEFAULT 'ENUM(''x'')')"


def test_document_pipeline(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", 5, "x"), ("a", 3, "y")], "k string, v int, s string")
    got = Q.aggregate(t, [{"$group": {"_id": "$k", "s": {"$sum": "$v"}}}, {"$sort": {"_id": 1}}])
    assert [tuple(r) for r in got.collect()] == [("a", 4), ("b", 5)]
    assert Q.find(t, {"s": None}).count() == 1 and Q.find(t, {"s": {"$exists": True}}).count() == 2
    assert Q.find(t, {"$nor": [{"k": "a"}]}).count() == 1
    with pytest.raises(ValueError):
        Q.find(t, {"v": {"$near": 1}})
    up = Q.document_update(t, {"k": "a"}, {"$inc": {"v": 10}, "$unset": {"s": ""}})
    assert sorted((r.v, r.s) for r in up.collect() if r.k == "a") == [(11, None), (13, None)]


def test_key_value_commands(spark):
    kv = spark.createDataFrame([("n", "string", "4", None), ("h", "hash", '{"a":"1"}', None), ("l", "list", '["x","y","z"]', None)], "key string, type string, value string, expiry timestamp")
    run = lambda df, c: [tuple(r) for r in Q.run_kv(df, c).collect()]
    assert run(kv, "GET n") == [("4",)] and run(kv, "HGET h a") == [("1",)] and run(kv, "LLEN l") == [(3,)]
    assert run(kv, "LRANGE l -2 -1") == [(0, "y"), (1, "z")] and run(kv, "TTL n") == [(-1,)] and run(kv, "TYPE h") == [("hash",)]
    assert run(Q.run_kv(kv, "INCR n"), "GET n") == [("5",)] and run(Q.run_kv(kv, "DEL n"), "EXISTS n h") == [(1,)]
    assert run(Q.run_kv(kv, "HSET h b 2"), "HGET h b") == [("2",)] and run(Q.run_kv(kv, 'RPUSH l "q r"'), "LLEN l") == [(4,)]
    assert run(Q.run_kv(kv, "SADD s a a b"), "SCARD s") == [(2,)] and run(kv, "PING") == [("PONG",)] and run(Q.run_kv(kv, "FLUSHDB"), "DBSIZE") == [(0,)]


def test_questions():
    got = Q.understand("list orders where status is 'open' and amount at least 5")
    assert got["sql"] == "SELECT * FROM `orders` WHERE `status` = :p0 AND `amount` >= :p1" and got["args"] == {"p0": "open", "p1": 5}
    assert Q.understand("something about customers")["confidence"] == 0.5
    assert Q.variables("{{a}} {{ b }} {{a}}") == ["a", "b"]
