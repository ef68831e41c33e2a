"""Source files made from documents, and what is in them.

By suffix, several samples: the file's text, its findings (what, kind, source, target, line, owner) and its chunks
(first line, last line, type, name). In all of them {0} is the document's number, {t} its text on one line, which stands
in comments and gives nothing, and {p} the file's path. A document takes the sample of its number. Files of a sample
without chunks are one chunk, the module.
"""

from __future__ import annotations

R, E = "relation", "entity"

SAMPLES: dict[str, list[tuple[str, list[tuple], list[tuple]]]] = {
    ".py": [
        (
            "# {t}\nimport os, sys\nfrom pkg{0} import helper\n\nclass Thing{0}(Base.Kind):\n    def run(self):\n        return self.client.get(helper(1))\n    async def later(self):\n        pass\n\ndef top():\n    Thing{0}().run()\n",
            [
                (R, "imports_module", "{p}", "os", 2, None), (R, "imports_module", "{p}", "sys", 2, None), (R, "imports_from", "{p}", "pkg{0}.helper", 3, None),
                (E, "class", "{p}::Thing{0}", "Thing{0}", 5, None), (R, "inherits_from", "{p}", "Base.Kind", 5, "Thing{0}"),
                (E, "method", "{p}::Thing{0}.run", "run", 6, "Thing{0}"), (R, "has_method", "{p}::Thing{0}", "{p}::Thing{0}.run", 6, "Thing{0}"),
                (R, "calls", "{p}", "self.client.get", 7, None), (R, "calls", "{p}", "helper", 7, None), (R, "calls", "{p}", "Thing{0}", 12, None), (R, "calls", "{p}", "run", 12, None),
            ],
            [(5, 9, "class", "Thing{0}"), (6, 7, "method", "run"), (8, 9, "method", "later"), (11, 12, "function", "top")],
        ),
        ("# {t}\nvalue = {0}\n", [], []),
        (
            "async def main{0}(x):\n    'not(a call)'  # {t}\n    return [a.b.c(y) for y in load(x)]\n\n\nclass A:\n    pass\n",
            [(E, "class", "{p}::A", "A", 6, None), (R, "calls", "{p}", "a.b.c", 3, None), (R, "calls", "{p}", "load", 3, None)],
            [(1, 3, "function", "main{0}"), (6, 7, "class", "A")],
        ),
    ],
    ".ts": [
        (
            "/* {t} */\nimport { A } from './a{0}'\nimport Def,\n  * as ns from \"multi\"\nexport class View{0}<T> extends ns.Base<T> {\n  count = make(1);\n  go(x) { this.api.load(); render(`no(1)`); }\n  async stop(): Promise<void> {\n    new Thing(2); foo{0}().bar(3)\n  }\n}\n",
            [
                (R, "imports_module", "{p}", "./a{0}", 2, None), (R, "imports_module", "{p}", "multi", 3, None), (E, "class", "{p}::View{0}", "View{0}", 5, None),
                (R, "inherits_from", "{p}", "ns.Base", 5, "View{0}"), (R, "calls", "{p}", "make", 6, None), (R, "calls", "{p}", "this.api.load", 7, None),
                (R, "calls", "{p}", "render", 7, None), (R, "calls", "{p}", "foo{0}", 9, None),
            ],
            [(5, 11, "class", "View{0}"), (7, 7, "method", "go"), (8, 10, "method", "stop")],
        ),
        ("// {t}\nimport './side{0}'\nsetup()\n", [(R, "imports_module", "{p}", "./side{0}", 2, None), (R, "calls", "{p}", "setup", 3, None)], []),
        (
            "export default async function main{0}(a) {\n  const re = /fake\\(call\\)/g // {t}\n  list.map((y) => helper(y))\n}\ninterface Shape{0} { run(x: string): void }\nclass Plain {}\n",
            [(E, "class", "{p}::Plain", "Plain", 6, None), (R, "calls", "{p}", "list.map", 3, None), (R, "calls", "{p}", "helper", 3, None)],
            [(1, 4, "function", "main{0}"), (5, 5, "class", "Shape{0}"), (6, 6, "class", "Plain")],
        ),
    ],
    ".rs": [
        (
            "// {t}\nuse std::collections::HashMap;\nuse pkg{0}::{One, Two};\npub struct Node{0}<'a> { x: &'a str }\nimpl<'a> Show for Node{0}<'a> {\n    fn show(&self) -> String { format!(\"{}\", hidden(1)); io::print('('); self.x.len() }\n}\n",
            [
                (R, "imports_module", "{p}", "std::collections::HashMap", 2, None), (R, "imports_module", "{p}", "pkg{0}::{One, Two", 3, None),
                (E, "struct", "{p}::Node{0}", "Node{0}", 4, None), (R, "inherits_from", "{p}", "Show", 5, "Node{0}<'a>"),
                (R, "calls", "{p}", "io::print", 6, None), (R, "calls", "{p}", "self.x.len", 6, None),
            ],
            [(4, 4, "class", "Node{0}"), (6, 6, "method", "show")],
        ),
        ("// {t}\nmod part{0};\n", [], []),
        (
            "enum Kind { One(i32), Two }\ntrait Run{0} {\n    fn stop(&self);\n    fn go(&self) { step{0}(1); }\n}\nfn main() {\n    let r = r#\"raw call(1)\"#; // {t}\n    if let Some(q) = maybe() { q.run()?.chain() }\n}\n",
            [
                (E, "enum", "{p}::Kind", "Kind", 1, None), (E, "trait", "{p}::Run{0}", "Run{0}", 2, None), (R, "calls", "{p}", "step{0}", 4, None),
                (R, "calls", "{p}", "maybe", 8, None), (R, "calls", "{p}", "q.run", 8, None),
            ],
            [(1, 1, "class", "Kind"), (2, 5, "class", "Run{0}"), (4, 4, "method", "go"), (6, 9, "function", "main")],
        ),
    ],
    ".go": [
        (
            'package m\n// {t}\nimport (\n  "fmt"\n  x "a/b{0}"\n)\ntype Shape{0} interface {\n  Area(a int) float64\n}\ntype Box struct {\n  w int\n}\nfunc (b *Box) Area(a int) float64 { return math.Sqrt(b.w) }\nfunc main() { fmt.Println(`raw(1)`, "s(2)"); use{0}(2); y := []byte("x") }\n',
            [
                (R, "imports_module", "{p}", "fmt", 4, None), (R, "imports_module", "{p}", "a/b{0}", 5, None), (E, "interface", "{p}::Shape{0}", "Shape{0}", 7, None),
                (E, "struct", "{p}::Box", "Box", 10, None), (R, "calls", "{p}", "math.Sqrt", 13, None), (R, "calls", "{p}", "fmt.Println", 14, None), (R, "calls", "{p}", "use{0}", 14, None),
            ],
            [(7, 9, "class", "Shape{0}"), (10, 12, "class", "Box"), (13, 13, "method", "Area"), (14, 14, "function", "main")],
        ),
        ("package m\n/* {t} */\nvar x{0} = 1\n", [], []),
        (
            "package m\nfunc fill{0}(xs []int) []int { // {t}\n  ys := make([]int, len(xs))\n  copy(ys, xs)\n  if cap(ys) > 9 { panic(note{0}(ys)) }\n  defer recover()\n  return append(ys, next(new(int)))\n}\n",
            [(R, "calls", "{p}", "note{0}", 5, None), (R, "calls", "{p}", "next", 7, None)],
            [(2, 8, "function", "fill{0}")],
        ),
        (
            'package m\nimport "os"\ntype (\n  A{0} struct{ x int }\n  B = C\n)\nfunc Gen[T any](x T) T {\n  go run(3) // {t}\n  return conv(x)\n}\n',
            [(R, "imports_module", "{p}", "os", 2, None), (E, "struct", "{p}::A{0}", "A{0}", 4, None), (R, "calls", "{p}", "run", 8, None), (R, "calls", "{p}", "conv", 9, None)],
            [(3, 6, "class", "A{0}"), (7, 10, "function", "Gen")],
        ),
    ],
    ".astro": [
        (
            "---\nimport Card from '../Card{0}.astro'\nimport { one, two } from \"lib\"\nexport const title = 1 // {t}\n---\n<Card a=1 /><p>text</p><Layout>x</Layout>\n<Card />\n",
            [
                (R, "imports_from", "{p}", "../Card{0}.astro.Card", 2, None), (R, "imports_from", "{p}", "lib.one", 3, None), (R, "imports_from", "{p}", "lib.two", 3, None),
                (E, "function", "{p}::title", "title", 4, None), (R, "calls", "{p}", "Card", 6, None), (R, "calls", "{p}", "Layout", 6, None),
            ],
            [],
        ),
        ("<script>\nimport './side{0}'\nexport default function run() {}\n// {t}\n</script>\n<Page{0}>a</Page{0}>\n", [(R, "imports_module", "{p}", "./side{0}", 2, None), (E, "function", "{p}::run", "run", 3, None), (R, "calls", "{p}", "Page{0}", 6, None)], []),
    ],
    ".c": [
        (
            "static_assert(alignof(int) == 4);\ntemplate<class T>\nstruct box{0} {\n  decltype(make{0}(1)) v = static_cast<int>(other{0}(2));\n};\nbool operator==(int a) { return typeid(a) == noexcept(b); }\n",
            [
                (E, "struct", "{p}::box{0}", "box{0}", 3, None), (R, "calls", "{p}", "make{0}", 4, None), (R, "calls", "{p}", "other{0}", 4, None),
            ],
            [],
        ),
        (
            '#include "lib{0}.h"\n#include <stdio.h>\nstruct point{0} {\n  int x;\n};\nstatic int add(int a, int b) {\n  return helper{0}(a) + printf(b);\n}\n',
            [
                (R, "imports_module", "{p}", "lib{0}.h", 1, None), (R, "imports_module", "{p}", "stdio.h", 2, None), (E, "struct", "{p}::point{0}", "point{0}", 3, None),
                (E, "function", "{p}::add", "add", 6, None), (R, "calls", "{p}", "add", 6, None), (R, "calls", "{p}", "helper{0}", 7, None), (R, "calls", "{p}", "printf", 7, None),
            ],
            [],
        ),
        (
            "  #  include <a/b{0}.h>\nunion  u{0} { int a; };\nconst char* name(void);\ninline size_t len{0}(char c) { return 9; }\nif (x) while (y) go{0} (z);\n",
            [
                (R, "imports_module", "{p}", "a/b{0}.h", 1, None), (E, "struct", "{p}::u{0}", "u{0}", 2, None), (R, "calls", "{p}", "name", 3, None),
                (E, "function", "{p}::len{0}", "len{0}", 4, None), (R, "calls", "{p}", "len{0}", 4, None), (R, "calls", "{p}", "go{0}", 5, None),
            ],
            [],
        ),
    ],
}
