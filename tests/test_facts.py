"""Application facts from small sources."""

import json

from lodestone.operators import facts
from lodestone.sources.typescript import tokenize

APP = {
    "routes.ts": 'router.get("/health", () => "ok");\nrouter.group(() => {\n router.get("/users", [Users, "index"]);\n router.group(() => { router.post("/admin", [Users, "admin"]); }).prefix("/v2").middleware("throttle");\n}).prefix("/api").middleware("auth").guard("jwt");\ncache.get("/no");',
    "User.ts": '@Entity("users")\nexport class User {\n @Column()\n id: string;\n @Column() email = "";\n @HasMany("posts", Post)\n posts: Post[];\n @BeforeSave\n hash() { return { a: 1 }; }\n}',
    "harbour.ts": 'class ShipMoored { static EVENT_NAME = "ship.moored"; }\nquay.subscribe("tide.turned", (t) => {});\nquay.emit(new ShipMoored(7));\nquay.dispatch("crane.idle", { berth });\n@EventListener("ship.moored")\nclass Pilot { handle() {} }\nquay.emit(new CargoLanded());',
    "CargoLanded.ts": 'export class CargoLanded { static EVENT_NAME = "cargo.landed"; }',
    "Tides.ts": 'export class TideProvider {\n boot() { return 1; }\n register() { harbour.singleton("tides", () => table()); } }',
    "Kernel.ts": "export class K { globalMiddleware = [A, B];\n namedMiddleware = { auth: C, throttle: D }; }",
    "config.ts": 'export default defineConfig({ name: "n", port: process.env.PORT, level: env("L", "info"), on: false, tags: ["a"], plug: [X], db: { host: "h", port: 5432 } });',
    "tasks.ts": 'class T { @Schedule("* * * * *") run() {} @Schedule(X) go() {} }\nthis.scheduler.register("nightly", () => {});\ndefineResource({ name: "posts", actions: ["list"] });\ndefineResource(x);',
}


def of(kind, file):
    return [(line, name, detail) for line, name, detail in facts.KINDS[kind](tokenize(APP[file]))]


def test_routes():
    got = [(n, d["method"], d["controller"], d["action"], d["middleware"], d["guards"]) for _, n, d in of("route", "routes.ts")]
    assert got == [("/health", "GET", None, "<inline>", [], []), ("/api/users", "GET", "Users", "index", ["auth"], ["jwt"]), ("/api/v2/admin", "POST", "Users", "admin", ["auth", "throttle"], ["jwt"])]


def test_entities():
    ((_, name, d),) = of("entity", "User.ts")
    assert name == "User" and d == {"table": "users", "columns": ["id", "email"], "relations": [{"kind": "HasMany", "property": "posts", "target": "Post"}], "hooks": [{"kind": "BeforeSave", "method": "hash"}]}


def test_events():
    assert sorted((n, d["side"]) for _, n, d in of("event", "harbour.ts")) == [("<CargoLanded>", "emitter"), ("crane.idle", "emitter"), ("ship.moored", "emitter"), ("ship.moored", "subscriber"), ("tide.turned", "subscriber")]


def test_event_names_across_files(spark):
    rows = facts.events_across(spark.createDataFrame([*APP.items(), ("broken.ts", "class {{{ ( [ `")], "file string, text string")).filter("file = 'harbour.ts'").collect()
    assert ("cargo.landed", True) in {(r.name, json.loads(r.detail)["resolved"]) for r in rows} and len(rows) == 5


def test_providers_and_middleware():
    ((_, name, d),) = of("provider", "Tides.ts")
    assert name == "TideProvider" and d["lifecycle"] == {"boot": 2, "register": 3} and d["bindings"] == [{"kind": "singleton", "token": "tides"}]
    assert [(n, d.get("order", d.get("alias"))) for _, n, d in of("middleware", "Kernel.ts")] == [("A", 0), ("B", 1), ("C", "auth"), ("D", "throttle")]


def test_tasks_and_resources():
    assert [(n, d["cron"], d["confidence"]) for _, n, d in of("task", "tasks.ts")] == [("T.run", "* * * * *", "high"), ("T.go", None, "medium"), ("nightly", None, "high")]
    assert [(n, d["actions"], d["confidence"]) for _, n, d in of("resource", "tasks.ts")] == [("posts", ["list"], "high"), ("<dynamic>", facts.ACTIONS, "low")]


def test_facts_as_relation(spark):
    found = facts.facts(spark.createDataFrame(list(APP.items()), "file string, text string")).cache()
    assert found.count() == 3 + 1 + 5 + 1 + 4 + 1 + 3 + 2
    value = json.loads(found.filter("kind = 'config'").first().detail)["value"]
    assert value["port"] == {"env": "PORT", "default": None} and value["level"] == {"env": "L", "default": "info"} and value["on"] is False and value["plug"] == [{"unevaluated": True, "expression": "X"}]
    assert facts.config_value(found, "db.port").first().value == "5432" and facts.config_value(found, "db.none").count() == 0
