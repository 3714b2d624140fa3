from pyspark.sql import functions as F

from codeloom.functions import declared, shapes
from codeloom.operators import receivers

TS = {
    "src/factory.ts": 'import { User } from "./models";\n\nexport function buildUser(): User {\n  return new User();\n}\nexport class UserFactory {\n  static buildUser(): User {\n    return new User();\n  }\n}\nexport function later(): Promise<User> { return x; }\n',
    "src/models.ts": "export class User {\n  save() {}\n  me(): this { return this; }\n}\n",
    "src/repo.ts": "export class Repo {\n  save() {}\n}\n",
}
PY = {
    "app/factory.py": "from typing import Optional\nfrom .models import User\n\ndef build_user() -> User:\n    return User()\n\ndef maybe() -> Optional[User]:\n    return None\n\nclass UserFactory:\n    @staticmethod\n    def build_user() -> User:\n        return User()\n",
    "app/models.py": "class User:\n    def save(self):\n        pass\n",
    "app/repo.py": "class Repo:\n    def save(self):\n        pass\n",
}
PHP = {
    "app/Factories/UserFactory.php": "<?php\nnamespace App\\Factories;\n\nuse App\\Models\\User;\n\nclass UserFactory {\n    public function makeUser(): User {\n        return new User();\n    }\n}\nfunction build(): ?User { return null; }\n",
    "app/Models/User.php": "<?php\nnamespace App\\Models;\n\nclass User {\n    public function save() {}\n}\n",
    "app/Models/Repo.php": "<?php\nnamespace App\\Models;\n\nclass Repo {\n    public function save() {}\n}\n",
}


def targets(spark, files, path, lineage=None):
    sources = spark.createDataFrame(list(files.items()), "file_path string, text string")
    rows = receivers.member_calls(sources, sources.select(F.col("file_path").alias("path")), lineage and lineage(sources)).collect()
    return sorted((r.line, r.member, r.target_file_path, r.target_owner) for r in rows if r.file_path == path)


CASES = [
    (TS, "src/service.ts", "src/models.ts", 'import { buildUser } from "./factory";\n\nfunction run() {\n  const user = buildUser();\n  user.save();\n}\n', 5),
    (TS, "src/service.ts", "src/models.ts", 'import { buildUser as make } from "./factory";\nfunction run() {\n  const user = make();\n  user.save();\n}\n', 4),
    (TS, "src/service.ts", "src/models.ts", 'import { buildUser } from "./factory";\nfunction run() {\n  buildUser().save();\n}\n', 3),
    (TS, "src/service.ts", "src/models.ts", 'import { UserFactory as UF } from "./factory";\nfunction run() {\n  UF.buildUser()\n    .save();\n}\n', 4),
    (TS, "src/service.ts", "src/models.ts", 'import { later } from "./factory";\nasync function run() {\n  const user = await later();\n  user.save();\n}\n', 4),
    (TS, "src/service.ts", "src/models.ts", 'import { later } from "./factory";\nasync function run() {\n  (await later()).me().me().save();\n}\n', 3),
    (TS, "src/service.ts", "src/models.ts", 'import { User as Person } from "./models";\nfunction run(user: Person | null) {\n  const f = () => {\n    user.save();\n  };\n}\n', 4),
    (TS, "src/service.ts", "src/models.ts", 'import { User } from "./models";\nimport { Repo } from "./repo";\nfunction run() {\n  let x = new Repo();\n  x = 1;\n  const y = () => { const x = new User(); x.save(); };\n}\n', 6),
    (PY, "app/service.py", "app/models.py", "from .factory import build_user\n\ndef run():\n    user = build_user()\n    user.save()\n", 5),
    (PY, "app/service.py", "app/models.py", "from .factory import build_user\n\ndef run():\n    build_user().save()\n", 4),
    (PY, "app/service.py", "app/models.py", "from .factory import UserFactory as UF\n\ndef run():\n    UF.build_user().save()\n", 4),
    (PY, "app/service.py", "app/models.py", "from .factory import maybe\n\ndef run():\n    user = maybe()\n    other = user\n    other.save()\n", 6),
    (PY, "app/service.py", "app/models.py", "from .models import (\n    User as U,\n)\n\nclass A:\n    def run(self, u: 'U | None'):\n        x: U = None\n        x.save()\n", 8),
    (PHP, "app/Service.php", "app/Models/User.php", "<?php\nuse App\\Factories\\UserFactory;\n\nfunction run(UserFactory $factory) {\n    $factory->makeUser()->save();\n}\n", 5),
    (PHP, "app/Service.php", "app/Models/User.php", "<?php\nuse App\\Factories\\UserFactory as UF;\nfunction run(UF $factory) {\n    $user = $factory->makeUser();\n    $user\n        ->save();\n}\n", 6),
    (PHP, "app/Service.php", "app/Models/User.php", "<?php\nfunction run() {\n    $user = new \\App\\Models\\User();\n    $user->save();\n}\n", 4),
    (PHP, "app/Service.php", "app/Models/User.php", "<?php\nfunction run(?\\App\\Models\\User $user = null) {\n    $user->save();\n}\n", 3),
]


def test_factories_chains_awaits_and_aliases(spark):
    """All cases in one run, each in a folder and a namespace of its own."""
    files, want = {}, []
    for n, (others, path, goal, body, line) in enumerate(CASES):
        own = lambda text: text.replace("App\\", f"App{n}\\")  # noqa: B023, E731
        files |= {f"k{n}/{p}": own(t) for p, t in (others | {path: body}).items()}
        want.append((f"k{n}/{path}", line, "save", f"k{n}/{goal}", "User"))
    sources = spark.createDataFrame(list(files.items()), "file_path string, text string")
    rows = receivers.member_calls(sources, sources.select(F.col("file_path").alias("path"))).collect()
    assert sorted((r.file_path, r.line, r.member, r.target_file_path, r.target_owner) for r in rows if r.member == "save") == sorted(want)


def test_nothing_is_proven_without_a_type(spark):
    body = "import { buildUser } from './nowhere';\nfunction run(x, y: number) {\n  x.save(); y.save(); z.save(); buildUser().save();\n  const x2 = cond ? a : b;\n  x2.save();\n}\n"
    assert targets(spark, TS | {"src/service.ts": body}, "src/service.ts") == []


def test_long_chains_and_cycles(spark):
    n = 12
    files = {f"c{i}.py": f"from .c{(i + 1) % n} import C{(i + 1) % n}\n\nclass C{i}:\n    def next(self) -> C{(i + 1) % n}:\n        return None\n    def stop(self):\n        pass\n" for i in range(n)}
    files["a.py"] = "from .c0 import C0\ndef f() -> g:\n    pass\ndef g() -> f:\n    pass\ndef run():\n    a = C0()\n    b = a" + ".next()" * 30 + "\n    b.stop()\n    f().stop()\n"
    assert [x for x in targets(spark, files, "a.py") if x[1] == "stop"] == [(9, "stop", "c6.py", "C6")]


def test_inherited_members(spark):
    files = {f"k{i}.py": (f"from .k{i + 1} import K{i + 1}\n" if i < 20 else "") + f"class K{i}{f'(K{i + 1})' if i < 20 else ''}:\n    def own{i}(self):\n        pass\n" for i in range(21)}
    files["a.py"] = "from .k0 import K0\ndef run(k: K0):\n    k.own20()\n    k.own3()\n    k.none()\n"
    heritage = [(f"k{i}.py", f"K{i}", f"K{i + 1}") for i in range(20)]
    lineage = lambda sources: receivers.class_lineage(sources, spark.createDataFrame(heritage, "file_path string, child string, parent string"))
    assert targets(spark, files, "a.py", lineage) == [(3, "own20", "k20.py", "K20"), (4, "own3", "k3.py", "K3")]


def test_facts_of_rust():
    t = shapes.Tokens("use crate::a::B;\nimpl T for Foo { fn go(&self) -> Option<Bar> { self.x().y() } }\nfn main(q: &Foo) { let b = B::new()?; b.run(); }", "Rust")
    rows = [(r[0], r[1], r[2], r[4], r[5]) for r in declared.facts(t)]
    assert ("fn", "go", "Foo", None, "Option<Bar>") in rows and ("call", "y", "Foo", ["Foo", "x"], None) in rows
    assert ("bind", "b", None, ["B", "new"], None) in rows and ("call", "run", None, ["b"], None) in rows and ("import", "B", "B", None, "crate::a::B") in rows


def test_empty_and_odd_sources(spark):
    files = {"a.ts": "", "b.ts": "class { ( } ] x.y(", "c.md": "x.y()", "d.py": "def\nclass\nfrom x import\nx ="}
    assert targets(spark, files, "b.ts") == []
    sources = spark.createDataFrame([("a.ts", None), (None, "x.y()")], "file_path string, text string")
    assert receivers.member_calls(sources, sources.select(F.col("file_path").alias("path"))).count() == 0


def test_facts_come_once_from_several_tasks(spark):
    files = [(f"src/f{i}.ts", "class A {\n  go(): A { return x; }\n}\nconst a = new A();\na.go();\n") for i in range(40)]
    twice = spark.createDataFrame(files + files[:5], "file_path string, text string").coalesce(1)
    got = receivers.facts(twice).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    assert len({repr(r[:-1]) for r in got}) == len(got) == 40 * len([r for r in got if r.file_path == "src/f9.ts"])


def test_no_table_goes_through_the_driver(spark, monkeypatch, tmp_path):
    """Facts are estimated by the few bytes of their sources, so all that was made of them was broadcast."""
    plans, real = [], receivers.cut
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(receivers, "cut", lambda x: plans.append(plan(x)) or real(x))
    sources = spark.createDataFrame([*TS.items(), ("src/a.ts", 'import { buildUser } from "./factory";\nconst u = buildUser();\nu.me().save();\n')], "file_path string, text string")
    sources.write.parquet(f"{tmp_path}/sources")
    sources = spark.read.parquet(f"{tmp_path}/sources")
    found = receivers.member_calls(sources, sources.select(F.col("file_path").alias("path")))
    plans.append(plan(found))
    assert {(r.member, r.target_file_path) for r in found.collect()} == {("me", "src/models.ts"), ("save", "src/models.ts")}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
