"""For each rule code that it finds once and like code that it doesn't."""

CASES = {
    "rust/unsafe-block": ("fn f() { unsafe { g(); } }", "fn f() { g(); }"),
    "rust/unsafe-fn": ("unsafe fn f() {}", "fn f() {}"),
    "rust/unsafe-impl": ("unsafe impl Send for X {}", "impl Send for X {}"),
    "rust/raw-pointer-deref": ("let x = *ptr;", "let x = a * ptr;"),
    "rust/transmute": ("let x = std::mem::transmute(y);", "let x = mem::transmute(y);"),
    "rust/unwrap-panic": ("x.unwrap();", "x.unwrap_or(1);"),
    "rust/command-injection": ("Command::new(a.to_string());", 'Command::new("ls");'),
    "rust/sql-string": ('sqlx::query("a" + b);', 'sqlx::query("a");'),
    "rust/path-traversal": ("std::fs::read_to_string(p);", "fs::read_to_string(p);"),
    "rust/hardcoded-secret": ('let api_key = "ab12cd34ef56";', 'let api_key = "changeme1234";'),
    "rust/weak-crypto": ("use md5::Digest;", "use sha2::Digest;"),
    "rust/panic-in-library": ('panic!("x");', 'println!("x");'),
    "rust/lazy-static-race": ("lazy_static! { static ref A: u8 = 1; }", "static A: u8 = 1;"),
    "rust/refcell-usage": ("RefCell::new(1);", "Cell::new(1);"),
    "rust/unbounded-vec-push": ("for x in y { v.push(x) }", "for x in y { v.push(x); }"),
    "python/exec-eval": ("eval(x)\n", "ast.literal_eval(x)\n"),
    "python/sql-injection": ('cur.execute("a %s" % b)\n', 'cur.execute("a %s", (b,))\n'),
    "python/command-injection": ("os.system(x)\n", "os.getcwd()\n"),
    "python/pickle-load": ("pickle.loads(x)\n", "json.loads(x)\n"),
    "python/hardcoded-password": ('password = "hunter2hunter2"\n', 'password = "changeme"\n'),
    "python/assert-security": ("assert a == b\n", "assert a\n"),
    "python/debug-true": ("DEBUG = True\n", "DEBUG = False\n"),
    "python/weak-crypto": ("from Crypto.Cipher.DES import new\n", "from Crypto.Cipher.AES import new\n"),
    "python/requests-no-timeout": ("requests.get(u)\n", "requests.get(u, timeout=3)\n"),
    "python/tempfile-mktemp": ("tempfile.mktemp()\n", "tempfile.mkstemp()\n"),
    "python/logging-format-injection": ('logger.info("a %s", b)\n', 'logger.info("a")\n'),
    "python/dynamic-import": ("__import__(x)\n", "import_(x)\n"),
    "js/eval": ("eval(x);", "window.eval2(x);"),
    "js/innerhtml": ("el.innerHTML = x;", "el.textContent = x;"),
    "js/document-write": ("document.write(x);", "stream.write(x);"),
    "js/hardcoded-secret": ('const token = "abcd1234efgh";', 'const label = "abcd1234efgh";'),
    "js/sql-concat": ('db.query("SELECT " + a);', 'db.query("SELECT ?", a);'),
    "js/shell-exec": ("exec(cmd);", "re.exec(cmd);"),
    "js/regex-dos": ("const r = /(a+)b+/;", "const r = /ab/;"),
    "js/no-csrf": ("app.post(u, h);", "app.get(u, h);"),
    "js/prototype-pollution": ("Object.assign(target, s);", "Object.assign({}, s);"),
    "js/dynamic-require": ("require(x + y);", 'require("fs");'),
    "js/mutable-exports": ("export const C = {};", "const C = {};"),
    "js/unhandled-json-parse": ("JSON.parse(x);", "JSON.stringify(x);"),
    "go/sql-injection": ('db.Query("a" + b)\n', 'db.Query("a", b)\n'),
    "go/command-injection": ('exec.Command("ls")\n', 'cmd.Run("ls")\n'),
    "go/hardcoded-cred": ('password := "abc12345678"\n', 'label := "abc12345678"\n'),
    "go/tls-insecure": ("c := &tls.Config{InsecureSkipVerify: true}\n", "c := &tls.Config{InsecureSkipVerify: false}\n"),
    "go/weak-random": ("rand.Intn(5)\n", "rand.Perm(5)\n"),
    "go/path-traversal": ("os.Open(p)\n", "os.Getenv(p)\n"),
    "go/unhandled-error": ("_ = f()\n", "_ = x\n"),
    "go/defer-in-loop": ("for i := 0; i < 3; i++ {\n\tdefer g()\n}\n", "func f() {\n\tdefer g()\n}\n"),
    "go/sync-map-assertion": ("sync.Map().Load(k)\n", "m.Load(k)\n"),
    "go/unbuffered-channel": ("c := make(chan int)\n", "c := make([]int, 3)\n"),
    "go/context-no-timeout": ("context.Background()\n", "context.TODO()\n"),
}
LANGUAGES = {"rust": "rust", "python": "python", "js": "javascript", "go": "go"}
