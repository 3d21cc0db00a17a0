"""Cascades against sqlite's own."""

import random
import sqlite3

import pytest

from passagelake.operators import cascade

SQL = """
pragma foreign_keys = on;
create table users (owner_id text unique, name text);
create table documents (document_id int unique, owner_id text references users(owner_id) on delete cascade, checksum text);
create table chunks (chunk_id int, document_id int references documents(document_id) on delete cascade, owner_id text references users(owner_id) on delete cascade);
create table jobs (job_id int, document_id int references documents(document_id) on delete cascade, owner_id text references users(owner_id) on delete cascade);
create table sessions (session_id int unique, owner_id text references users(owner_id) on delete cascade);
create table messages (session_id int references sessions(session_id) on delete cascade, place int);
"""
SCHEMAS = {
    "users": "owner_id string, name string", "documents": "document_id int, owner_id string, checksum string", "chunks": "chunk_id int, document_id int, owner_id string", "jobs": "job_id int, document_id int, owner_id string",
    "sessions": "session_id int, owner_id string", "messages": "session_id int, place int",
}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    owner = lambda: rng.choice(["u0", "u1", "u2", "u3", None])
    document = lambda: rng.choice([*range(40), None])
    session = lambda: rng.choice([*range(12), None])
    return {
        "users": [(f"u{i}", "n") for i in range(5)], "documents": [(i, owner(), rng.choice("abcdefghijkl")) for i in range(40)], "chunks": [(i, document(), owner()) for i in range(200)],
        "jobs": [(i, document(), owner()) for i in range(60)], "sessions": [(i, owner()) for i in range(12)], "messages": [(session(), i) for i in range(50)] + [(3, 7), (3, 7)],
    }


@pytest.mark.parametrize("root, column, values", [("users", "owner_id", ["u1", "u3"]), ("documents", "document_id", [1, 5, 9, 77]), ("sessions", "session_id", [3]), ("users", "owner_id", []), ("users", "owner_id", ["u0", "u1", "u2", "u3", "u4"]), ("chunks", "chunk_id", [4])])
def test_cascades_are_those_of_a_database(spark, rows, root, column, values):
    con = sqlite3.connect(":memory:")
    con.executescript(SQL)
    for name, them in rows.items():
        con.executemany(f"insert into {name} values ({', '.join('?' * len(them[0]))})", them)
    files = {c for (c,) in con.execute("select checksum from documents")}
    con.executemany(f"delete from {root} where {column} = ?", [(v,) for v in values])
    tables = {n: spark.createDataFrame(them, SCHEMAS[n]) for n, them in rows.items()}
    kind = dict(p.split(" ") for p in SCHEMAS[root].split(", "))[column]
    left, gone = cascade.delete(tables, root, spark.createDataFrame([(v,) for v in [*values, *values, None]], f"{column} {kind}"))
    ordered = lambda them: sorted(map(tuple, them), key=repr)
    for name, them in rows.items():
        kept = ordered(con.execute(f"select * from {name}").fetchall())
        assert ordered(left[name].collect()) == kept
        assert name not in gone or ordered([*map(tuple, gone[name].collect()), *kept]) == ordered(them)
    if "documents" in gone:
        used = {c for (c,) in con.execute("select checksum from documents")}
        assert {r[0] for r in cascade.unlinked(gone["documents"], left["documents"]).collect()} == files - used


def test_circles_are_refused(spark):
    a = spark.createDataFrame([(1, 1)], "id int, up int")
    keys = [cascade.ForeignKey("a", "up", "b", "id"), cascade.ForeignKey("b", "up", "a", "id")]
    with pytest.raises(ValueError, match="circle"):
        cascade.delete({"a": a, "b": a}, "a", a.select("id"), keys)
