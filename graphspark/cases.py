"""Small sources in each language, whose facts are known by hand: what extraction is held against."""

from __future__ import annotations

SOURCES = {
    "app/main.py": '''import os.path
from lib.tools import load as fetch

__all__ = ["Store", "run_all"]

class Store(Base):
    size: int = 0

    def __init__(self, root, *rest, mode="r"):
        self.root = root

    @staticmethod
    def open(name: str) -> Store:
        return name

async def run_all(items: list):
    total = 0
    for item in items:
        total += fetch(item, *items, key=item)
    a, b = total, items
    with open(a) as handle:
        found = [x for x in handle if x]
    try:
        return found
    except OSError as error:
        print(error.args, lambda y: y)
''',
    "web/page.js": '''import Api, { get as fetchIt, post } from './api';
const fs = require('fs');
let count = 0, { left, right } = load(count);
class View extends Base {
  constructor(root) { this.root = root; }
  show(items, ...rest) { this.draw(items); return items; }
}
function draw(a, b = 1) { count = a; return fetchIt('/api/x', a, ...b, () => b); }
const twice = (n) => n + n;
View.prototype.hide = function (x) { return x; };
module.exports = { draw };
''',
    "web/types.ts": '''export interface User { id: number; name?: string; greet(other: User): string; }
export type Pair = [User, User];
export enum Colour { Red, Green }
export class Box<T> { private value: T; constructor(public label: string) {} get(): T { return this.value; } }
''',
    "svc/user.go": '''package user

import (
	"fmt"
	str "strings"
)

const Limit = 10

type User struct {
	Name string
	age  int
}

type Greeter interface {
	Greet(name string) string
}

func (u *User) Greet(name string) string {
	text := fmt.Sprintf("%s", name)
	return text
}

func Make(a, b int, rest ...string) (*User, error) {
	var u User
	u.age = a
	go help(b)
	return &u, nil
}
''',
    "svc/broken.py": "def (:\n",
    "notes.txt": "def f(): pass\n",
}

#: What extraction says of the sources, reviewed line by line against the rules: ``node|kind|id|annotation|parameter|place`` and
#: ``edge|kind|from|to|arguments or decorator|place``. The file that doesn't parse is known as a file, the text not at all.
FACTS = """
node|File|app/main.py#|||app/main.py:1:0
node|External|#external:os|||app/main.py:1:0
node|External|#external:lib.tools.load|||app/main.py:2:0
node|Variable|app/main.py#fetch|||app/main.py:2:0
node|Variable|app/main.py#__all__|||app/main.py:4:0
node|Class|app/main.py#Store|||app/main.py:6:0
node|Variable|app/main.py#Store.size|int||app/main.py:7:4
node|Function|app/main.py#Store.__init__|||app/main.py:9:4
node|Variable|app/main.py#Store.__init__.self||parameter|app/main.py:9:17
node|Variable|app/main.py#Store.__init__.root||parameter|app/main.py:9:23
node|Variable|app/main.py#Store.__init__.mode||parameter|app/main.py:9:36
node|Variable|app/main.py#Store.__init__.rest||parameter|app/main.py:9:30
node|Function|app/main.py#Store.open|Store||app/main.py:13:4
node|Variable|app/main.py#Store.open.name|str|parameter|app/main.py:13:13
node|Function|app/main.py#run_all|||app/main.py:16:0
node|Variable|app/main.py#run_all.items|list|parameter|app/main.py:16:18
node|Variable|app/main.py#run_all.total|||app/main.py:17:4
node|Variable|app/main.py#run_all.item|||app/main.py:18:8
node|Variable|app/main.py#run_all.a|||app/main.py:20:4
node|Variable|app/main.py#run_all.b|||app/main.py:20:4
node|Variable|app/main.py#run_all.handle|||app/main.py:21:20
node|Variable|app/main.py#run_all.found|||app/main.py:22:8
node|Variable|app/main.py#run_all.x|||app/main.py:22:23
node|Variable|app/main.py#run_all.error|||app/main.py:25:4
node|Function|app/main.py#run_all.<lambda>|||app/main.py:26:26
node|Variable|app/main.py#run_all.<lambda>.y|||app/main.py:26:33
node|External|#external:open|||app/main.py:21:9
node|External|#external:print|||app/main.py:26:8
edge|defines|app/main.py#|app/main.py#__all__||app/main.py:4:0
edge|defines|app/main.py#|app/main.py#Store||app/main.py:6:0
edge|defines|app/main.py#Store|app/main.py#Store.__init__||app/main.py:9:4
edge|defines|app/main.py#Store|app/main.py#Store.open||app/main.py:13:4
edge|defines|app/main.py#|app/main.py#run_all||app/main.py:16:0
edge|imports|app/main.py#|#external:os||app/main.py:1:0
edge|imports|app/main.py#|#external:lib.tools.load||app/main.py:2:0
edge|assigns|app/main.py#|app/main.py#fetch||app/main.py:2:0
edge|assigns|app/main.py#|app/main.py#__all__||app/main.py:4:0
edge|reads|app/main.py#|app/main.py#Store||app/main.py:4:11
edge|reads|app/main.py#|app/main.py#run_all||app/main.py:4:20
edge|reads|app/main.py#|app/main.py#__all__||app/main.py:4:0
edge|assigns|app/main.py#Store|app/main.py#Store.size||app/main.py:7:4
edge|assigns|app/main.py#Store.__init__|app/main.py#Store.__init__.self||app/main.py:10:8
edge|writes|app/main.py#Store.__init__|app/main.py#Store.__init__.self||app/main.py:10:8
edge|reads|app/main.py#Store.__init__|app/main.py#Store.__init__.self||app/main.py:10:8
edge|reads|app/main.py#Store.__init__|app/main.py#Store.__init__.root||app/main.py:10:20
edge|reads|app/main.py#Store.open|app/main.py#Store||app/main.py:13:27
edge|decorates|app/main.py#Store.open|app/main.py#Store.open|staticmethod|app/main.py:13:4
edge|returns|app/main.py#Store.open|app/main.py#Store.open.name||app/main.py:14:8
edge|reads|app/main.py#Store.open|app/main.py#Store.open.name||app/main.py:14:15
edge|assigns|app/main.py#run_all|app/main.py#run_all.total||app/main.py:17:4
edge|reads|app/main.py#run_all|app/main.py#run_all.total||app/main.py:17:4
edge|reads|app/main.py#run_all|app/main.py#run_all.item||app/main.py:18:8
edge|reads|app/main.py#run_all|app/main.py#run_all.items||app/main.py:18:16
edge|writes|app/main.py#run_all|app/main.py#run_all.total||app/main.py:19:8
edge|reads|app/main.py#run_all|app/main.py#run_all.total||app/main.py:19:8
edge|calls|app/main.py#run_all|app/main.py#fetch|0:name::item 1:starred::items -1:kw:key:item|app/main.py:19:17
edge|reads|app/main.py#run_all|app/main.py#fetch||app/main.py:19:17
edge|reads|app/main.py#run_all|app/main.py#run_all.item||app/main.py:19:23
edge|reads|app/main.py#run_all|app/main.py#run_all.items||app/main.py:19:30
edge|reads|app/main.py#run_all|app/main.py#run_all.item||app/main.py:19:41
edge|assigns|app/main.py#run_all|app/main.py#run_all.a||app/main.py:20:4
edge|assigns|app/main.py#run_all|app/main.py#run_all.b||app/main.py:20:4
edge|reads|app/main.py#run_all|app/main.py#run_all.a||app/main.py:20:4
edge|reads|app/main.py#run_all|app/main.py#run_all.b||app/main.py:20:7
edge|reads|app/main.py#run_all|app/main.py#run_all.total||app/main.py:20:11
edge|reads|app/main.py#run_all|app/main.py#run_all.items||app/main.py:20:18
edge|calls|app/main.py#run_all|#external:open|0:name::a|app/main.py:21:9
edge|reads|app/main.py#run_all|app/main.py#run_all.a||app/main.py:21:14
edge|reads|app/main.py#run_all|app/main.py#run_all.handle||app/main.py:21:20
edge|assigns|app/main.py#run_all|app/main.py#run_all.found||app/main.py:22:8
edge|reads|app/main.py#run_all|app/main.py#run_all.found||app/main.py:22:8
edge|reads|app/main.py#run_all|app/main.py#run_all.x||app/main.py:22:17
edge|reads|app/main.py#run_all|app/main.py#run_all.x||app/main.py:22:23
edge|reads|app/main.py#run_all|app/main.py#run_all.handle||app/main.py:22:28
edge|reads|app/main.py#run_all|app/main.py#run_all.x||app/main.py:22:38
edge|returns|app/main.py#run_all|app/main.py#run_all.found||app/main.py:24:8
edge|reads|app/main.py#run_all|app/main.py#run_all.found||app/main.py:24:15
edge|calls|app/main.py#run_all|#external:print|0:attr::error 1:other::|app/main.py:26:8
edge|reads|app/main.py#run_all|app/main.py#run_all.error||app/main.py:26:14
edge|reads|app/main.py#run_all.<lambda>|app/main.py#run_all.<lambda>.y||app/main.py:26:36
node|File|web/page.js#|||web/page.js:1:0
node|External|#external:./api.Api|||web/page.js:1:0
node|Variable|web/page.js#Api|||web/page.js:1:7
node|External|#external:./api.get|||web/page.js:1:0
node|Variable|web/page.js#fetchIt|||web/page.js:1:21
node|External|#external:./api.post|||web/page.js:1:0
node|Variable|web/page.js#post|||web/page.js:1:30
node|Variable|web/page.js#fs|||web/page.js:2:6
node|External|#external:fs|||web/page.js:2:6
node|Variable|web/page.js#count|||web/page.js:3:4
node|Variable|web/page.js#left|||web/page.js:3:17
node|Variable|web/page.js#right|||web/page.js:3:23
node|Class|web/page.js#View|||web/page.js:4:0
node|Function|web/page.js#View.constructor|||web/page.js:5:2
node|Variable|web/page.js#View.constructor.root||parameter|web/page.js:5:14
node|Function|web/page.js#View.show|||web/page.js:6:2
node|Variable|web/page.js#View.show.items||parameter|web/page.js:6:7
node|Variable|web/page.js#View.show.rest||parameter|web/page.js:6:17
node|Function|web/page.js#draw|||web/page.js:8:0
node|Variable|web/page.js#draw.a||parameter|web/page.js:8:14
node|Variable|web/page.js#draw.b||parameter|web/page.js:8:17
node|Variable|web/page.js#twice|||web/page.js:9:6
node|Variable|web/page.js#twice.n||parameter|web/page.js:9:15
node|Function|web/page.js#View.hide|||web/page.js:10:0
node|Variable|web/page.js#View.hide.x||parameter|web/page.js:10:32
node|External|#external:load|||web/page.js:3:33
node|External|#external:this.draw|||web/page.js:6:25
edge|imports|web/page.js#|#external:./api.Api||web/page.js:1:0
edge|assigns|web/page.js#|web/page.js#Api||web/page.js:1:0
edge|imports|web/page.js#|#external:./api.get||web/page.js:1:0
edge|assigns|web/page.js#|web/page.js#fetchIt||web/page.js:1:0
edge|imports|web/page.js#|#external:./api.post||web/page.js:1:0
edge|assigns|web/page.js#|web/page.js#post||web/page.js:1:0
edge|assigns|web/page.js#|web/page.js#fs||web/page.js:2:6
edge|imports|web/page.js#|#external:fs||web/page.js:2:6
edge|assigns|web/page.js#|web/page.js#count||web/page.js:3:4
edge|assigns|web/page.js#|web/page.js#left||web/page.js:3:15
edge|assigns|web/page.js#|web/page.js#right||web/page.js:3:15
edge|calls|web/page.js#|#external:load|0:name::count|web/page.js:3:33
edge|reads|web/page.js#|web/page.js#count||web/page.js:3:38
edge|defines|web/page.js#|web/page.js#View||web/page.js:4:0
edge|defines|web/page.js#View|web/page.js#View.constructor||web/page.js:5:2
edge|reads|web/page.js#View.constructor|web/page.js#View.constructor.root||web/page.js:5:34
edge|defines|web/page.js#View|web/page.js#View.show||web/page.js:6:2
edge|calls|web/page.js#View.show|#external:this.draw|0:name::items|web/page.js:6:25
edge|reads|web/page.js#View.show|web/page.js#View.show.items||web/page.js:6:35
edge|returns|web/page.js#View.show|web/page.js#View.show.items||web/page.js:6:43
edge|reads|web/page.js#View.show|web/page.js#View.show.items||web/page.js:6:50
edge|defines|web/page.js#|web/page.js#draw||web/page.js:8:0
edge|assigns|web/page.js#draw|web/page.js#count||web/page.js:8:26
edge|reads|web/page.js#draw|web/page.js#draw.a||web/page.js:8:34
edge|calls|web/page.js#draw|web/page.js#fetchIt|0:other:: 1:name::a 2:starred::b 3:other::|web/page.js:8:44
edge|reads|web/page.js#draw|web/page.js#fetchIt||web/page.js:8:44
edge|reads|web/page.js#draw|web/page.js#draw.a||web/page.js:8:62
edge|reads|web/page.js#draw|web/page.js#draw.b||web/page.js:8:68
edge|reads|web/page.js#draw|web/page.js#draw.b||web/page.js:8:77
edge|assigns|web/page.js#|web/page.js#twice||web/page.js:9:6
edge|reads|web/page.js#twice|web/page.js#twice.n||web/page.js:9:21
edge|reads|web/page.js#twice|web/page.js#twice.n||web/page.js:9:25
edge|defines|web/page.js#View|web/page.js#View.hide||web/page.js:10:0
edge|returns|web/page.js#View.hide|web/page.js#View.hide.x||web/page.js:10:37
edge|reads|web/page.js#View.hide|web/page.js#View.hide.x||web/page.js:10:44
edge|reads|web/page.js#|web/page.js#draw||web/page.js:11:19
node|File|web/types.ts#|||web/types.ts:1:0
node|Class|web/types.ts#User|||web/types.ts:1:7
node|Variable|web/types.ts#User.id|number||web/types.ts:1:24
node|Variable|web/types.ts#User.name|string||web/types.ts:1:36
node|Function|web/types.ts#User.greet|string||web/types.ts:1:51
node|Variable|web/types.ts#User.greet.other|User|parameter|web/types.ts:1:57
node|Class|web/types.ts#Pair|||web/types.ts:2:7
node|Class|web/types.ts#Colour|||web/types.ts:3:7
node|Variable|web/types.ts#Colour.Red|||web/types.ts:3:21
node|Variable|web/types.ts#Colour.Green|||web/types.ts:3:26
node|Class|web/types.ts#Box|||web/types.ts:4:7
node|Variable|web/types.ts#Box.value|T||web/types.ts:4:22
node|Function|web/types.ts#Box.constructor|||web/types.ts:4:40
node|Variable|web/types.ts#Box.constructor.label|string|parameter|web/types.ts:4:59
node|Function|web/types.ts#Box.get|T||web/types.ts:4:77
edge|defines|web/types.ts#|web/types.ts#User||web/types.ts:1:7
edge|defines|web/types.ts#User|web/types.ts#User.id||web/types.ts:1:24
edge|defines|web/types.ts#User|web/types.ts#User.name||web/types.ts:1:36
edge|defines|web/types.ts#User|web/types.ts#User.greet||web/types.ts:1:51
edge|defines|web/types.ts#|web/types.ts#Pair||web/types.ts:2:7
edge|defines|web/types.ts#|web/types.ts#Colour||web/types.ts:3:7
edge|defines|web/types.ts#Colour|web/types.ts#Colour.Red||web/types.ts:3:21
edge|defines|web/types.ts#Colour|web/types.ts#Colour.Green||web/types.ts:3:26
edge|defines|web/types.ts#|web/types.ts#Box||web/types.ts:4:7
edge|defines|web/types.ts#Box|web/types.ts#Box.value||web/types.ts:4:22
edge|defines|web/types.ts#Box|web/types.ts#Box.constructor||web/types.ts:4:40
edge|defines|web/types.ts#Box|web/types.ts#Box.get||web/types.ts:4:77
node|File|svc/user.go#|||svc/user.go:1:0
node|External|#external:fmt|||svc/user.go:4:1
node|External|#external:strings|||svc/user.go:5:5
node|Variable|svc/user.go#str|||svc/user.go:5:1
node|Variable|svc/user.go#Limit|||svc/user.go:8:6
node|Class|svc/user.go#User|||svc/user.go:10:5
node|Variable|svc/user.go#User.Name|string||svc/user.go:11:1
node|Variable|svc/user.go#User.age|int||svc/user.go:12:1
node|Class|svc/user.go#Greeter|||svc/user.go:15:5
node|Function|svc/user.go#Greeter.Greet|string||svc/user.go:16:1
node|Variable|svc/user.go#Greeter.Greet.name|string|parameter|svc/user.go:16:7
node|Function|svc/user.go#User.Greet|string||svc/user.go:19:0
node|Variable|svc/user.go#User.Greet.u|*User|parameter|svc/user.go:19:6
node|Variable|svc/user.go#User.Greet.name|string|parameter|svc/user.go:19:21
node|Variable|svc/user.go#User.Greet.text|||svc/user.go:20:1
node|Function|svc/user.go#Make|(*User, error)||svc/user.go:24:0
node|Variable|svc/user.go#Make.a|int|parameter|svc/user.go:24:10
node|Variable|svc/user.go#Make.b|int|parameter|svc/user.go:24:13
node|Variable|svc/user.go#Make.rest|string|parameter|svc/user.go:24:20
node|Variable|svc/user.go#Make.u|User||svc/user.go:25:5
node|External|#external:fmt.Sprintf|||svc/user.go:20:9
node|External|#external:help|||svc/user.go:27:4
edge|imports|svc/user.go#|#external:fmt||svc/user.go:4:1
edge|imports|svc/user.go#|#external:strings||svc/user.go:5:5
edge|assigns|svc/user.go#|svc/user.go#str||svc/user.go:5:1
edge|assigns|svc/user.go#|svc/user.go#Limit||svc/user.go:8:6
edge|defines|svc/user.go#|svc/user.go#User||svc/user.go:10:5
edge|defines|svc/user.go#User|svc/user.go#User.Name||svc/user.go:11:1
edge|defines|svc/user.go#User|svc/user.go#User.age||svc/user.go:12:1
edge|defines|svc/user.go#|svc/user.go#Greeter||svc/user.go:15:5
edge|defines|svc/user.go#Greeter|svc/user.go#Greeter.Greet||svc/user.go:16:1
edge|defines|svc/user.go#User|svc/user.go#User.Greet||svc/user.go:19:0
edge|assigns|svc/user.go#User.Greet|svc/user.go#User.Greet.text||svc/user.go:20:1
edge|calls|svc/user.go#User.Greet|#external:fmt.Sprintf|0:other:: 1:name::name|svc/user.go:20:9
edge|reads|svc/user.go#User.Greet|svc/user.go#User.Greet.name||svc/user.go:20:27
edge|returns|svc/user.go#User.Greet|svc/user.go#User.Greet.text||svc/user.go:21:1
edge|reads|svc/user.go#User.Greet|svc/user.go#User.Greet.text||svc/user.go:21:8
edge|defines|svc/user.go#|svc/user.go#Make||svc/user.go:24:0
edge|assigns|svc/user.go#Make|svc/user.go#Make.u||svc/user.go:25:5
edge|writes|svc/user.go#Make|svc/user.go#Make.u||svc/user.go:26:1
edge|reads|svc/user.go#Make|svc/user.go#Make.a||svc/user.go:26:9
edge|calls|svc/user.go#Make|#external:help|0:name::b|svc/user.go:27:4
edge|reads|svc/user.go#Make|svc/user.go#Make.b||svc/user.go:27:9
edge|reads|svc/user.go#Make|svc/user.go#Make.u||svc/user.go:28:9
node|File|svc/broken.py#|||svc/broken.py:1:0
"""


def facts_sql() -> str:
    """The facts as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, line.split('|')))})" for line in FACTS.strip().splitlines())
    return f"SELECT * FROM (VALUES {rows}) AS t(fact, kind, a, b, said, place)"
