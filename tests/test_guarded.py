"""The walk over ad-hoc statements."""

import pytest

from retrievo.operators.guarded import RejectedSql, check_select, guarded_select, relations, _lexemes

ALLOWED = {"users", "orders"}

GOOD = [
    ("select id from users", ["users"]),
    ("SELECT u.id FROM users u, orders o WHERE u.id = o.uid", ["users", "orders"]),
    ("select * from (users u join orders o on u.id = o.uid)", ["users", "orders"]),
    ("select * from (select id from users) x left join lateral (select 1 from orders where orders.uid = x.id) y", ["users", "orders"]),
    ("select count(*) from users where exists (select 1 from orders) and id in (select uid from orders, users)",
     ["users", "orders", "orders", "users"]),
    ("select id from users union all select uid from orders", ["users", "orders"]),
    ("select extract(year from d) from orders", ["orders"]),
    ("select id from users where name is distinct from 'from admins; -- drop table'", ["users"]),
    ("select case when a > 1 then 'x' else 'y' end, id from users group by 1, 2 order by 1, 2 limit 5;;", ["users"]),
    ("select substring(name, 1, 2), round(1.5e3, 0) from users", ["users"]),
]
BAD = [
    None, "", " ; ", "delete from users", "select 1", "select id from admins", "select id from users, admins",
    "select id from users u join (orders o cross join admins a)", "select id from (select id from admins) x",
    "select id from users where id in (select id from admins)", "select id from users -- all", "select id /* x */ from users",
    "select id from users; select 1 from users", "select id from `users`", 'select id from "users"', "select id from db.users",
    "select id from range(5)", "select id from users, range(5)", "select * from values (1)", "select reflect('x', 'y') from users",
    "select id from users for update", "select id from users where name = 'a\\' or 1 = 1 --'", "with a as (select 1) select * from a",
    "select id from users)", "select (id from users", "select id from users lateral view explode(x) t as y", "select ${x} from users",
    "select create from users", "select id from users where 1 = (select max(id) from admins)", "select id from table(f())",
    "select id from users u, lateral (select id from admins) x", "select id from 'users'", "select id from users@x",
]


@pytest.mark.parametrize("sql, read", GOOD)
def test_let_through(sql, read):
    assert check_select(sql, ALLOWED) == sql.rstrip(";")
    assert relations(_lexemes(sql.rstrip(";"))) == read


@pytest.mark.parametrize("sql", BAD)
def test_refused(sql):
    with pytest.raises(RejectedSql):
        check_select(sql, ALLOWED)


def test_names_that_the_session_could_resolve():
    with pytest.raises(RejectedSql, match="out of reach"):
        check_select("select id from users where x = secrets", ALLOWED, known={"secrets"})
    with pytest.raises(RejectedSql, match="out of reach"):
        check_select("select main.users.id from users", ALLOWED, namespaces={"main"})
    assert check_select("select u.main from users u", ALLOWED, namespaces={"main"})


def test_spark_reads_the_statements_alike(spark):
    tables = {"users": lambda s: s.sql("select 1 id, 'a' name, 2 a, date'2024-01-01' d"),
              "orders": lambda s: s.sql("select 1 uid, date'2024-01-01' d")}
    for sql, _ in GOOD:
        guarded_select(spark, sql, tables).collect()
