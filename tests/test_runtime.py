from codestrata.config import ensure_checkpoints
from codestrata.operators import review as W
from codestrata.operators import runtime as E
from codestrata.sources import diffs as D

PYTHON = '''
@app.get("/x")
def page():
    pass

@receiver(
    sig)
def got():
    pass

@pytest.mark.slow
class Slow:
    @cached
    def plain(self):
        pass

@command
async def bare():
    pass

@other.receiver
def no():
    pass

class H(urllib.request.HTTPHandler, metaclass=M):
    def ftp_open(self):
        pass
    def opened(self):
        pass
    def http_error_404(self):
        pass
    def on_moved(self):
        pass

class W(FileSystemEventHandler):
    def on_moved(self):
        pass

class Plain:
    def on_moved(self):
        pass
    def ftp_open(self):
        pass
'''
PHP = '''<?php
class User extends Model implements CanResetPasswordContract {
    /** all posts of {@see Post} */
    public function posts(): HasMany { return $this->hasMany(Post::class); }
    private function hidden(): HasMany { return 1; }
    function owner(): ?Rel\\BelongsTo { return 1; }
    /** @dataProvider rows */
    public function checked() {}
    /** @\\App\\Notes\\TypeItem(1) */
    protected static function typed() {}
    /** @return int */
    public function counted(): int { return 1; }
    /** @Route("/x") */
    private $field;
    public function afterField() {}
    public function getEmailForPasswordReset() {}
    public static function FOO(): self { return new self('FOO'); }
    public static function BAR($a = array(1)): static { return new static("BAR"); }
    public static function BAZ(): self { return new self('QUX'); }
    public function QUUX(): self { return new self('QUUX'); }
}
'''
JAVA = '''
public class V1__a extends BaseJavaMigration { }
class V2 implements Runnable, JavaMigration { }
class V3<T> extends Base<JavaMigration> implements List<Map<A, B>> { }
class V4 extends org.flywaydb.core.api.migration.BaseJavaMigration { }
class V5 extends com.example.BaseJavaMigration { }
class V6 { }
'''


def test_entries(spark):
    ensure_checkpoints(spark)
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("bad.py", "python", "@x(\n"), ("u.php", "php", PHP), ("m.java", "java", JAVA), ("n.py", "python", None), ("r.rb", "ruby", "@app.get\n")], "path string, lang string, text string")
    got = {(r["path"], r["name"], r["sl"], r["reason"]) for r in E.entries(files).collect()}
    line = lambda s: PYTHON[: PYTHON.index(s)].count("\n")
    assert {g[1:] for g in got if g[0] == "a.py"} == {
        ("page", line("def page"), "decorator"), ("got", line("def got"), "decorator"), ("Slow", line("class Slow"), "decorator"), ("bare", line("async def bare"), "decorator"),
        ("ftp_open", line("def ftp_open"), "protocol"), ("http_error_404", line("def http_error_404"), "protocol"), ("on_moved", line("class W") + 1, "protocol"),
    }
    assert {g[1:] for g in got if g[0] == "u.php"} == {
        ("posts", None, "relation"), ("owner", None, "relation"), ("checked", None, "annotation"), ("typed", None, "annotation"), ("getEmailForPasswordReset", None, "contract"), ("FOO", None, "enum"), ("BAR", None, "enum"),
    }
    assert {g[1] for g in got if g[0] == "m.java"} == {"V1__a", "V2", "V4"}
    assert {g[0] for g in got} == {"a.py", "u.php", "m.java"}
    assert E.entries(files.where("false")).count() == 0


def test_dead_code_leaves_them_out(spark):
    ensure_checkpoints(spark)
    text = "@app.get('/')\ndef page():\n    pass\n\n\ndef lonely():\n    pass\n"
    files = spark.createDataFrame([("a.py", "python", text)], "path string, lang string, text string")
    assert [r["name"] for r in W.dead(files, D.parse(D.all_added(files))).collect()] == ["lonely"]
