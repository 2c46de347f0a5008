"""Statement grammars of the five languages for :mod:`codestrata.llm.chart`.

Terminals: n name, 0 number, s string, P ( ) group, B [ ] group, C { } group, keywords and
operators as written; ``o`` is any operator that is only binary, ``~=`` a compound assignment, ``bar`` the vertical bar.
Groups are checked on their own, so a statement is short.  Several grammars take a superset where
context would decide (an object literal, a block and a list of members share rules).
"""

from __future__ import annotations

_JS = """
S -> E | E ; | ; | V | V ; | F | K | K ; | Flow | I | I ; | X | X ; | M | M ; | case E : | case E : S | default : | default : S | n : S
St -> C | E | E ; | V ; | V | Flow | ;
V -> Vk Bs
Vk -> const | let | var
Bs -> Bd | Bd , Bs
Bd -> Tg Ty | Tg Ty = E
Tg -> N | B | C
F -> async function Star N G P R C | function Star N G P R C
Star -> * |
K -> Dc class N G Ex C | Dc class Ex C
Dc -> @ Q Pq Dc |
Q -> N | Q . N
Pq -> P |
Ex -> extends Po A | 
Flow -> if P St | if P St else St | for P St | for await P St | while P St | do St while P | do St while P ; | try C catch P C | try C catch C | try C finally C | try C catch P C finally C | try C catch C finally C | switch P C | return | return ; | return E | return E ; | throw E | throw E ; | break Nq | break Nq ; | continue Nq | continue Nq ; | debugger | debugger ;
Nq -> N |
I -> import s | import N from s | import C from s | import * as N from s | import N , C from s | import N , * as N from s
X -> export default E | export default F | export default async function Star G P R C | export default function Star G P R C | export default K | export V | export F | export K | export C | export C from s | export * from s | export * as N from s
M -> Md Pn P R C | Md Pn Ty | Md Pn Ty = E | Md Pn = E | Dc M
Md -> Mk Md |
Mk -> static | async | get | set | *
Pn -> N | s | 0 | B | # N
N -> n | from | as | of | get | set | static | async | type | declare | namespace | abstract | readonly | public | private | protected | interface | implements | override | is | keyof
E -> U | U Op E | U ? E : E | U = E | U ~= E | Ar | yield | yield E | yield * E
Op -> o | + | - | * | / | < | > | > > | > > > | bar | & | in | instanceof
U -> Po | Pr U | Po ++ | Po --
Pr -> ! | ~ | + | - | ++ | -- | typeof | void | delete | await
Po -> Pm | Po . N | Po . # N | Po ?. N | Po ?. P | Po ?. B | Po P | Po B | Po s
Pm -> N | 0 | s | r | P | B | C | function Star Nq G P R C | async function Star Nq G P R C | class Ex C | class N G Ex C | new Po | new . N | import P | import . N | # N
Ar -> N => Ab | P => Ab | async N => Ab | async P => Ab
Ab -> E | C
L -> | Its | Its ,
Its -> It | It , Its | , Its
It -> E | ... E | Pm = E | Pn : E | Pn : Vl | Md Pn P R C | Md B P R C | ... N | V | await E
Vl -> F
H -> Hi ; Eq ; Eq | Vk Tg of E | Vk Tg in E | E of E | E in E
Hi -> V | E , Eq | E |
Eq -> Es |
Es -> E | E , Es
"""

_JS_PLAIN = """
Ty ->
R ->
G ->
A ->
"""

_TS = """
Ty -> : T | ? : T | ! : T | ? |
R -> : T | : asserts N | : N is T | : asserts N is T |
G -> < Tp > | < Tp , > |
Tp -> T1 | T1 , Tp
T1 -> N | N extends T | N = T | N extends T = T | const N | in N | out N
A -> < Tl > |
Tl -> T | T , Tl
T -> Tu | Tu extends T ? T : T | Gf P => T | new P => T | abstract new P => T
Gf -> < Tp > |
Tu -> Ti | Tu bar Ti | bar Ti
Ti -> Tx | Ti & Tx | & Tx
Tx -> Q A | 0 | - 0 | s | P | B | C | Tx B | typeof Q | keyof Tx | readonly Tx | unique Tx | infer N | this | void | null | import P . Q A | function
K -> Dc Am class N G Ex Im C | interface N G Ie C | Dc Am enum N C | const enum N C | type N G = T | declare S | namespace Q C | module s C | declare global C
Am -> abstract | declare |
Im -> implements Tl |
Ie -> extends Tl |
Mk -> public | private | protected | readonly | abstract | override | declare | accessor
M -> Md Pn Q1 G P R | Md Pn Q1 G P R C | Md Pn Q1 Ty | Md Pn Q1 Ty = E | P R | G P R | new P R | Md B : T | Md B ? : T | Md B - ? : T
Q1 -> ? | ! |
E -> U as T | U satisfies T | U as T Op E
Po -> Po ! | Po A P | < T > Po
Ar -> G P R => Ab | async G P R => Ab | P R => Ab | async P R => Ab
It -> Dc Md Tg Ty | Dc Md Tg Ty = E | ... Tg Ty | Md Pn Q1 G P R C | this : T | T | N ? : T | N : T | ... T | ... N : T | type N | type N as N | N as N
X -> export type C | export type C from s | export = E | export as namespace N | export import N = Q | export declare S | export default K
I -> import type C from s | import type N from s | import type * as N from s | import N = E
"""

_JS_EXTRA = """
It -> N as N | s as N | N as s | default as N | N as default
"""

GRAMMAR_JS = _JS + _JS_PLAIN + _JS_EXTRA
GRAMMAR_TS = _JS + _TS + _JS_EXTRA

GRAMMAR_JAVA = """
Top -> package Q ; | An package Q ; | import Q ; | import static Q ; | import Q . * ; | import static Q . * ; | D | D ; | ; | Me
D -> Ms class n G Xt Im Pt C | Ms interface n G Xl Pt C | Ms enum n Im C | Ms @ interface n C | Ms record n G P Im C
G -> < Gl > |
Gl -> G1 | G1 , Gl
G1 -> An n | n | n extends Tb | An n extends Tb
Tb -> T | T & Tb
Xt -> extends T |
Xl -> extends Tl |
Im -> implements Tl |
Pt -> permits Tl |
Tl -> T | T , Tl
Ms -> M1 Ms |
M1 -> An | public | private | protected | static | final | abstract | default | synchronized | native | transient | volatile | strictfp | sealed | non-sealed
An -> @ Q | @ Q P
Q -> n | Q . n
T -> Tq Bs | An Tq Bs
Tq -> n A | Tq . n A
A -> < > | < Al > |
Al -> Ta | Ta , Al
Ta -> T | ? | ? extends T | ? super T | An ?
Bs -> B Bs |
Mem -> Me | D | D ; | ; | C | static C | Ec
Me -> Ms G T n P Bs Th C | Ms G T n P Bs Th ; | Ms G T n P Bs default E ; | Ms G n P Th C | Ms n C | Ms T Vs ;
Th -> throws Tl |
Vs -> V1 | V1 , Vs
V1 -> n Bs | n Bs = E
Ec -> El | El , | El ; | El , ;
El -> E1 | E1 , El
E1 -> An n Pq Cq | n Pq Cq
Pq -> P |
Cq -> C |
S -> Ms T Vs ; | E ; | ; | C | D | if P S | if P S else S | for P S | while P S | do S while P ; | try Pq C Cs | try Pq C Cs finally C | try P C | try C finally C | try P C finally C | switch P C | return ; | return E ; | throw E ; | break ; | break n ; | continue ; | continue n ; | yield E ; | synchronized P C | assert E ; | assert E : E ; | n : S | case Cl : | case Cl : S | case Cl -> E ; | case Cl -> C | case Cl -> throw E ; | default : | default : S | default -> E ; | default -> C | default -> throw E ; | Me
Cs -> catch P C | catch P C Cs
Cl -> E | E , Cl | T n | default | null , default
E -> U | U Op E | U ? E : E | U = E | U ~= E | Lm | U instanceof T | U instanceof final T n | U instanceof T n | U instanceof T Op E | U instanceof T n Op E | U instanceof T n ? E : E | U instanceof T ? E : E | U instanceof T P
Op -> o | + | - | * | / | < | > | > > | > > > | & | bar
U -> Po | Pr U | Po ++ | Po -- | P U1 | P Lm
U1 -> Po | ! U | ~ U | P U1 | Po ++ | Po --
Pr -> ! | ~ | + | - | ++ | --
Po -> Pm | Po . n | Po . Ag n | Po . new n A Pq Cq | Po P | Po B | Po :: n | Po :: new | Po . class | Tq < Al > :: n | Tq A :: new | Po . this
Ag -> < Al >
Pm -> n | 0 | s | P | C | new Tq P | new Tq P C | new Tq B Bs | new Tq B Bs C | switch P C | n B . class | n B :: new | new Ag Tq P
Lm -> n -> Lb | P -> Lb
Lb -> E | C
L -> | Is | Is ,
Is -> It | It , Is
It -> E | Pm1 | n = E | An | n = An
Pm1 -> Ms T n Bs | Ms T ... n | Ms T n = E | Ms T this | Ms Un n
Un -> T | T Ub
Ub -> bar T | bar T Ub
H -> Hi ; Eq ; Hs | Ms T n : E | Rs | Rs ;
Hi -> Ms T Vs | Hs
Hs -> Es |
Es -> E | E , Es
Eq -> E |
Rs -> R1 | R1 ; Rs
R1 -> Ms T n = E | E
"""

GRAMMAR_GO = """
Top -> package n | import s | import P | import n s | import . s | func n Gq P R C | func P n P R C | func n Gq P R | De
De -> var Sp | const Sp | type n Gq T | type n = T | type n Gq = T | var P | const P | type P
Sp -> Nl | Nl T | Nl = El | Nl T = El
Gq -> B |
Nl -> n | n , Nl
R -> T | P |
T -> Q | Q B | * T | B T | map B T | chan T | chan <- T | <- chan T | func P R | interface C | struct C | P | ~ T | T bar T
Q -> n | n . n
S -> Si | De | if Hd C | if Hd C else C | if Hd C else S | for C | for Fh C | switch C | switch Hd C | switch Si ; C | select C | go E | defer E | return | return El | break | break n | continue | continue n | goto n | fallthrough | n : | n : S | case El : | case El : S | case Si : | case Si : S | default : | default : S | C | Fd
Fd -> Nl T | Nl T s | T s | T | n P R | n P R C
Hd -> E | Si ; E | ; E | Si
Fh -> E | Siq ; Eq ; Siq | El := range E | El = range E | range E | Siq ; Eq ;
Siq -> Si |
Eq -> E |
Si -> El | El := El | El = El | El ~= E | E ++ | E -- | E <- E | El := Sx | El = Sx
Sx -> E
El -> E | E , El
E -> U | U Op E
Op -> o | + | - | * | / | < | > | & | bar | ^ | > >
U -> Po | Pr U
Pr -> ! | + | - | * | & | <- | ^ | ~
Po -> Pm | Po . n | Po . P | Po . type | Po P | Po B | Po C
Pm -> n | 0 | s | P | B T C | B T P | map B T C | map B T P | map B T | B T | chan T | chan <- T | <- chan T | func P R C | func P R | struct C C | interface C | struct C | interface C P | struct C P | C | * T
L -> | Is | Is , | type
Is -> It | It , Is
It -> E | E ... | Nl1 T | n ... T | ... T | E : E | C : C | E : C | C : E | : E | E : | E : E : E | : | : E : E | T
Nl1 -> n
Gr -> Sp | n s | s | . s | _ s | n Gq T | n = T | n Gq = T
"""

GRAMMAR_PY = """
S -> Si | Hd : | Hd : Si | @ E | async Hd1 : | async Hd1 : Si
Hd1 -> def N Gq P Re | for Tl in El | with Wl | with P
Re -> - > E |
Gq -> B |
Hd -> Hd1 | class N Gq | class N Gq P | if E | elif E | else | while E | try | except | except E | except E as N | except * E | except * E as N | except E , El | finally | match El | case Pt | case Pt if E
Pt -> E | E as N | E , Pt | E , | * N | * N , Pt
Wl -> W1 | W1 , Wl
W1 -> E | E as Tg
Si -> El | As | El ~= El | El : E | El : E = El | return | return El | raise | raise E | raise E from E | import Im | from Fr import Ia | pass | break | continue | global Nl | nonlocal Nl | del El | assert E | assert E , E | type N Gq = E | Tl ~= yield
As -> Tl = El | Tl = As | Tl = yield | Tl = yield El | Tl = yield from E | yield | yield El | yield from E
Im -> I1 | I1 , Im
I1 -> Q | Q as N
Q -> N | Q . N
Fr -> Q | Ds | Ds Q
Ds -> . | ... | . Ds | ... Ds
Ia -> * | P | Il
Il -> N | N as N | N , Il | N as N , Il
Nl -> N | N , Nl
Tl -> El
El -> Ei | Ei , | Ei , El
Ei -> E | * E | N := E
Tg -> E
N -> n | match | case | type
E -> O | O if O else E | lambda Lp : E | lambda : E
O -> Nt | Nt Bo O
Bo -> and | or | in | not in | is | is not | o | + | - | * | / | < | > | bar | & | ^ | @ | > > | **
Nt -> U | not Nt
U -> Po | Pr U | await U
Pr -> + | - | ~
Po -> Pm | Po . N | Po P | Po B
Pm -> N | 0 | Str | P | B | C | ...
Str -> s | s Str
Lp -> L1 | L1 , Lp | L1 ,
L1 -> N | N = E | * N | ** N | * | /
L -> | Is | Is ,
Is -> It | It , Is
It -> Ei | ** E | N = E | N : E | N : E = E | * N : E | * N : * E | ** N : E | * | / | E : E | Cf | E as N | yield | yield El | N as N | Sl | E : Cm
Cm -> E
Cf -> Ei Fs | E : E Fs | ** E Fs
Fs -> F1 | F1 Fs
F1 -> for Tl in O | async for Tl in O | if O | if lambda : E | if N := E | for Tl in O if O else E
Sl -> Eq : Eq | Eq : Eq : Eq
Eq -> E |
"""
