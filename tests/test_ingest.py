import json

import pytest
from pyspark.sql import functions as F

from pulseyard.operators import ingest

SERVER = dict(
    id=1, ip="8.8.8.8", port=28960, version="1", game="g1", hostname="host", clientnum=3, maxclientnum=18,
    map="mp_a", gametype="tdm",
)


def beat(server=None, drop=(), **changes):
    servers = [{k: v for k, v in {**SERVER, **(server or {})}.items() if k not in drop}]
    return {"id": "a", "version": "1.0.0.0", "uptime": 5, "servers": servers, **changes}


CASES = {
    "plain": (beat(), []),
    "no servers": (beat(servers=[]), []),
    "64 servers": (beat(servers=[SERVER] * 64), []),
    "65 servers": (beat(servers=[SERVER] * 65), ["servers:invalid server count"]),
    "uptime -1": (beat(uptime=-1), ["uptime:invalid uptime"]),
    "uptime 0": (beat(uptime=0), []),
    "uptime max": (beat(uptime=2147483647), []),
    "uptime over": (beat(uptime=2147483648), ["uptime:invalid uptime"]),
    "uptime huge": (beat(uptime=10**30), ["uptime:invalid uptime"]),
    "uptime text": (beat(uptime="12"), []),
    "uptime decimal": (beat(uptime=12.7), []),
    "uptime decimal text": (beat(uptime="12.7"), ["uptime:Not a valid integer."]),
    "uptime null": (beat(uptime=None), ["uptime:Field may not be null."]),
    "uptime list": (beat(uptime=[1]), ["uptime:Not a valid integer."]),
    "id low": (beat({"id": -25525525525565535}), []),
    "id high": (beat({"id": 25525525525565535}), []),
    "id below": (beat({"id": -25525525525565536}), ["servers.0.id:invalid id"]),
    "id above": (beat({"id": 25525525525565536}), ["servers.0.id:invalid id"]),
    "port -1": (beat({"port": -1}), []),
    "port 0": (beat({"port": 0}), ["servers.0.port:invalid port"]),
    "port 65536": (beat({"port": 65536}), ["servers.0.port:invalid port"]),
    "port text": (beat({"port": "80"}), ["servers.0.port:Not a valid integer."]),
    "port decimal": (beat({"port": 80.0}), ["servers.0.port:Not a valid integer."]),
    "port absent": (beat(drop=("port",)), ["servers.0.port:Missing data for required field."]),
    "game empty": (beat({"game": ""}), []),
    "game 8": (beat({"game": "g" * 8}), []),
    "game 9": (beat({"game": "g" * 9}), ["servers.0.game:invalid game name"]),
    "hostname empty": (beat({"hostname": ""}), ["servers.0.hostname:invalid hostname"]),
    "hostname 256": (beat({"hostname": "é" * 256}), []),
    "hostname 257": (beat({"hostname": "h" * 257}), ["servers.0.hostname:invalid hostname"]),
    "clientnum -1": (beat({"clientnum": -1}), ["servers.0.clientnum:invalid clientnum"]),
    "clientnum 128": (beat({"clientnum": 128}), []),
    "clientnum 129": (beat({"clientnum": 129}), ["servers.0.clientnum:invalid clientnum"]),
    "clientnum true": (beat({"clientnum": True}), ["servers.0.clientnum:Not a valid integer."]),
    "clientnum text": (beat({"clientnum": "12"}), []),
    "clientnum decimal": (beat({"clientnum": 12.7}), []),
    "more clients than slots": (beat({"clientnum": 10, "maxclientnum": 4}), []),
    "map 128": (beat({"map": "m" * 128}), []),
    "map 129": (beat({"map": "m" * 129}), ["servers.0.map:invalid map name"]),
    "map number": (beat({"map": 5}), ["servers.0.map:Not a valid string."]),
    "gametype absent": (beat(drop=("gametype",)), []),
    "gametype empty": (beat({"gametype": ""}), ["servers.0.gametype:invalid gametype"]),
    "gametype 16": (beat({"gametype": "g" * 16}), []),
    "gametype 17": (beat({"gametype": "g" * 17}), ["servers.0.gametype:invalid gametype"]),
    "gametype null": (beat({"gametype": None}), ["servers.0.gametype:Field may not be null."]),
    "server version absent": (beat(drop=("version",)), []),
    "server version 129": (beat({"version": "v" * 129}), ["servers.0.version:invalid server version"]),
    "server version null": (beat({"version": None}), ["servers.0.version:Field may not be null."]),
    "ip number": (beat({"ip": 5}), ["servers.0.ip:Not a valid string."]),
    "server unknown key": (beat({"extra": 1}), ["servers.0.extra:Unknown field."]),
    "unknown key": (beat(extra=1), ["extra:Unknown field."]),
    "server not object": (beat(servers=[SERVER, 5]), ["servers.1:Invalid input type."]),
    "servers object": (beat(servers={}), ["servers:Invalid input type."]),
    "servers null": (beat(servers=None), ["servers:Field may not be null."]),
    "version number": (beat(version=1.0), []),
    "version null": (beat(version=None), ["version:Field may not be null."]),
    "webfront null": (beat(webfront_url=None), []),
    "webfront number": (beat(webfront_url=5), ["webfront_url:Not a valid string."]),
    "two faults": (beat({"port": 0, "map": 1}, uptime=-1), ["uptime:invalid uptime", "servers.0.port:invalid port", "servers.0.map:Not a valid string."]),
    "id number": (beat(id=7), ["id:Not a valid string."]),
    "array": ([1], ["_schema:Invalid input type."]),
}
for name in ("id", "version", "uptime", "servers"):
    document = beat()
    del document[name]
    CASES[f"{name} absent"] = (document, [f"{name}:Missing data for required field."])


@pytest.fixture(scope="module")
def validated(spark):
    rows = [(json.dumps(doc), "203.0.113.9", name) for name, (doc, _) in CASES.items()]
    rows += [("not json", "203.0.113.9", "bad json"), (None, "203.0.113.9", "no body")]
    raw = spark.createDataFrame(rows, "body string, remote_ip string, name string").withColumn(
        "received_at", F.timestamp_seconds(F.lit(1_700_000_000.9))
    )
    return {r.name: r for r in ingest.validate_heartbeats(raw).collect()}, raw


def test_errors(validated):
    rows, _ = validated
    for name, (_, expected) in CASES.items():
        assert [f"{e.path}:{e.message}" for e in rows[name].errors] == expected, name
    for name in ("bad json", "no body"):
        assert [e.path for e in rows[name].errors] == ["_schema"]


def test_values(validated):
    rows, _ = validated
    assert rows["port -1"].servers[0].port == 65535
    assert rows["clientnum text"].servers[0].clientnum == 12
    assert rows["clientnum decimal"].servers[0].clientnum == 12
    assert rows["uptime text"].uptime == 12 and rows["uptime decimal"].uptime == 12
    assert rows["gametype absent"].servers[0].gametype == "Unknown"
    assert rows["server version absent"].servers[0].version == "Unknown"
    assert (rows["version number"].version_kind, rows["plain"].version_kind) == ("number", "text")
    plain = rows["plain"]
    assert plain.last_heartbeat == 1_700_000_000 and plain.ip_address == "203.0.113.9"
    assert plain.webfront_url == "http://203.0.113.9:1624"


def test_server_address_repair(spark):
    addresses = {
        "8.8.8.8": "8.8.8.8", "x": "203.0.113.9", "10.0.0.4": "203.0.113.9", "127.0.0.1": "203.0.113.9",
        "::1": "203.0.113.9", "2001:db8::1": "2001:db8::1", None: "203.0.113.9",
    }
    docs = [beat({"ip": a}) for a in addresses] + [beat(drop=("ip",))]
    raw = spark.createDataFrame([(json.dumps(d), "203.0.113.9", i) for i, d in enumerate(docs)], "body string, remote_ip string, i int")
    got = ingest.validate_heartbeats(raw.withColumn("received_at", F.timestamp_seconds(F.lit(0)))).orderBy("i").collect()
    assert [r.servers[0].ip for r in got] == [*addresses.values(), "203.0.113.9"]
    assert all(not r.errors for r in got)


def test_client_heartbeat_time_is_ignored(spark):
    raw = spark.createDataFrame([(json.dumps(beat(last_heartbeat=5, ip_address="1.1.1.1")), "2.2.2.2")], "body string, remote_ip string")
    row = ingest.validate_heartbeats(raw.withColumn("received_at", F.timestamp_seconds(F.lit(99)))).first()
    assert (row.last_heartbeat, row.ip_address, row.errors) == (99, "2.2.2.2", [])


def test_quarantine_splits_whole_input(validated):
    rows, raw = validated
    good, bad = ingest.reject_quarantine(raw)
    names_good = {r.name for r in good.select("name").collect()}
    names_bad = {r.name: r for r in bad.collect()}
    assert names_good == {n for n, r in rows.items() if not r.errors}
    assert set(names_bad) == {n for n, r in rows.items() if r.errors}
    assert names_bad["bad json"].body == "not json"
