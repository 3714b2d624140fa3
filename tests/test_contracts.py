import time

from codeloom.operators import assess, text


def hits(spark, *files):
    return {(r.category, r.value, r.line) for r in text.contract_hits(spark.createDataFrame(list(files), "file_path string, text string")).collect()}


def test_values_in_groups(spark):
    ts = "type Status = 'draft' | 'published';\ntype Long =\n  | 'one'\n  | 'two';\nconst keys = ['alpha', 'beta'] as const;\nfunction f(mode: 'fast' | 'slow') {}\nconst plain = ['x', 'y'];\n"
    assert hits(spark, ("src/a.ts", ts)) == {("symbolic_literals", v, n) for v, n in (("draft", 1), ("published", 1), ("one", 3), ("two", 4), ("alpha", 5), ("beta", 5), ("fast", 6), ("slow", 6))}
    php = "<?php\nregister_post_type(array('book' => 1,\n  'label' => 'x'));\n// register_x(array('off' => 1));\n"
    assert hits(spark, ("a.php", php)) == {("registered_keys", "book", 2), ("registered_keys", "label", 3)}
    assert hits(spark, ("b.php", ts)) == set()


def test_markup_and_controllers(spark):
    html = '<div data-controller="search-panel"\n data-action="click->search-panel#open keyup->list#go"></div>'
    found = hits(spark, ("a.vue", html), ("app/controllers/admin/user_list_controller.js", "x"), ("app/other/x_controller.js", "x"))
    assert found == {("symbolic_literals", "search-panel", 1), ("symbolic_literals", "search-panel", 2), ("symbolic_literals", "list", 2), ("symbolic_literals", "admin--user-list", 1)}


def test_searches_that_are_cut_short_are_told(spark):
    rows = [(f"b{i}", ["common", f"own{i}"]) for i in range(5)] + [("many", [f"k{i}" for i in range(10)]), ("fine", ["own1"])]
    got = assess.truncated_searches(spark.createDataFrame(rows, "id string, keys array<string>"), most_bucket=4).collect()
    assert sorted(tuple(r) for r in got) == sorted([(f"b{i}", 1, 0) for i in range(5)] + [("many", 0, 2)])


def test_lines_of_very_many_contracts(spark):
    """Lines are found from the text's breaks, once, not for each match by counting from the beginning."""
    n = 200_000
    long = "\n".join(f'let k = env::var("KEY_{i % 7}");' for i in range(n))
    began = time.monotonic()
    got = [(r.line, r.value) for r in text.contract_hits(spark.createDataFrame([("src/long.rs", long)], "file_path string, text string")).collect()]
    assert sorted(got) == [(i + 1, f"KEY_{i % 7}") for i in range(n)]
    assert time.monotonic() - began < 60


def test_words_that_stand_before_patterns_leave_no_match_out():
    """Each pattern's own texts hold one of its words."""
    import re

    texts = {
        "routes": ['#[Route(path: "/a")', '#[Route("/a")', 'Route::get("/a")', 'router.use("/a")', "match '/a'", "mount Api::Root => '/a'"],
        "hooks": ["add_filter('a')", "apply_filters('a')", "do_action('a')", "register_uninstall_hook('a')"],
        "registered_keys": ["Register_x('a')", "BIND('a')", "singleton('a')", "Alias('a')", "command('a')", "schedule('a')", "ſchedule('a')", "BİND('a')"],
        "env_keys": ["env('A')", "getenv('A')", "std::env::var_os('A')", "env!('A')", "option_env!('A')", "$_ENV['A']", "$_SERVER['A']", "os.environ.get('A')", "os.environ['A']", "ENV.fetch('A')", "ENV['A']", "process.env.A", "process.env['A']", "import.meta.env.A"],
        "config_keys": ["config('a')", "get_option('a')", "register_setting('a')"],
        "channels": ["socket.send('a')", "io.on('a'", "ws.on('a'", "Echo.join('a'", "Broadcast::channel('a'", "new PrivateChannel('a'", "x.publish('a'", "x.psubscribe('a'", "x->trigger('a'"],
        "http_calls": ["Http::get('a'", "fetch('a'", "axios.get('a'", "axios({url: 'a'", "->request('GET', 'a'", "curl_setopt($c, CURLOPT_URL, 'a'", "wp_remote_post('a'"],
        "symbolic_literals": ["new CustomEvent('a')", "data-controller='a'"],
    }
    for category, pattern, words in text.CONTRACTS:
        for t in texts[category]:
            if re.search(pattern, t):
                assert any(w in (t.lower() if pattern.startswith("(?i)") else t) for w in words) or not t.isascii()
        assert any(re.search(pattern, t) for t in texts[category]), pattern
