"""Grammars of the languages that source files are checked against."""

from __future__ import annotations

PYTHON_RESERVED = """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda
nonlocal not or pass raise return try while with yield"""
PYTHON = r"""
start: line*
line: NEWLINE | stmt
stmt: simple NEWLINE | compound
simple: small (';' small)* ';'?
small: exprs | assign | 'pass' | 'break' | 'continue' | 'return' starexprs? | 'raise' (test ('from' test)?)? | 'global' IDENT (',' IDENT)* | 'nonlocal' IDENT (',' IDENT)*
    | 'del' targets | 'assert' test (',' test)? | importing | 'type' IDENT tparams? '=' test
assign: (single | '(' single ')') ':' test ('=' value)? | (targets '=')+ value | (single | '(' single ')') augment value
augment: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
value: starexprs | yielding
exprs: starexprs | yielding
yielding: 'yield' starexprs? | 'yield' 'from' test
importing: 'import' dotted ('as' IDENT)? (',' dotted ('as' IDENT)?)* | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
imported: '*' | names | '(' names ','? ')'
names: IDENT ('as' IDENT)? (',' IDENT ('as' IDENT)?)*
dotted: IDENT ('.' IDENT)*
compound: ifs | whiles | fors | tries | withs | funcdef | classdef | 'async' (funcdef | withs | fors) | decorated | matching
decorated: ('@' named NEWLINE)+ (funcdef | classdef | 'async' funcdef)
suite: simple NEWLINE | NEWLINE INDENT stmt+ DEDENT
ifs: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
whiles: 'while' named ':' suite ('else' ':' suite)?
fors: 'for' targets 'in' starexprs ':' suite ('else' ':' suite)?
tries: 'try' ':' suite (except+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
except: 'except' ':' suite | 'except' '*'? test ('as' IDENT)? ':' suite
withs: 'with' withitem (',' withitem)* ':' suite | 'with' '(' withitem (',' withitem)* ','? ')' ':' suite
withitem: test ('as' target)?
funcdef: 'def' IDENT tparams? '(' params? ')' ('->' starexprs)? ':' suite
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ('*' | '**')? IDENT (':' test)? ('=' test)?
params: param (',' param)* ','?
param: IDENT (':' test)? ('=' test)? | '*' (IDENT (':' startest)?)? | '**' IDENT (':' test)? | '/'
classdef: 'class' IDENT tparams? ('(' args? ')')? ':' suite
matching: 'match' starexprs ':' NEWLINE INDENT case+ DEDENT
case: 'case' patterns ('if' named)? ':' suite
patterns: pattern (',' pattern)* ','?
pattern: orpattern ('as' IDENT)? | '*' IDENT
orpattern: closed ('|' closed)*
closed: '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False' | dotted | dotted '(' (patarg (',' patarg)* ','?)? ')' | '(' patterns? ')' | '[' patterns? ']'
    | '{' (mapitem (',' mapitem)* ','?)? '}'
patarg: pattern | IDENT '=' pattern
mapitem: closed ':' pattern | '**' IDENT
single: IDENT | primary '.' IDENT | primary '[' slices ']'
target: single | '(' targets? ')' | '[' targets? ']'
targets: startarget (',' startarget)* ','?
startarget: '*'? target
starexprs: startest (',' startest)* ','?
startest: '*' orexpr | named
tests: test (',' test)* ','?
named: IDENT ':=' test | test
test: disjunction ('if' disjunction 'else' test)? | 'lambda' lparams? ':' test
lparams: lparam (',' lparam)* ','?
lparam: IDENT ('=' test)? | '*' IDENT? | '**' IDENT | '/'
disjunction: inversion (('and' | 'or') inversion)*
inversion: 'not' inversion | comparison
comparison: orexpr (compare orexpr)*
compare: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
orexpr: unary (binary unary)*
binary: '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@'
unary: ('+' | '-' | '~') unary | power
power: 'await'? primary ('**' unary)?
primary: atom | primary '.' IDENT | primary '(' args? ')' | primary '[' slices ']'
args: named comp | placed (',' placed)* (',' keyed)* ','? | keyed (',' keyed)* ','?
placed: named | '*' test
keyed: IDENT '=' test | '*' test | '**' test
slices: slice (',' slice)* ','?
slice: startest | test? ':' test? (':' test?)?
atom: IDENT | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' starexprs ')' | '(' yielding ')' | '(' named comp ')' | '[' ']' | '[' starexprs ']' | '[' startest comp ']'
    | '{' '}' | '{' starexprs '}' | '{' startest comp '}' | '{' dictitem (',' dictitem)* ','? '}' | '{' dictitem comp '}'
dictitem: test ':' test | '**' orexpr
comp: ('async'? 'for' targets 'in' disjunction compif*)+
compif: 'if' compcond
compcond: disjunction | IDENT ':=' disjunction | 'lambda' lparams? ':' compcond
"""

SCRIPT_RESERVED = """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null
return super switch this throw true try typeof var void while with"""
#: Shared by both script languages, which fill the rules named t_... .
SCRIPT = r"""
start: item*
item: stmt | importing | exporting
importing: 'import' STRING attributes? ';' | 'import' imported 'from' STRING attributes? ';'
imported: IDENT | namespaced | named | IDENT ',' namespaced | IDENT ',' named
namespaced: '*' 'as' IDENT
named: '{' (spec (',' spec)* ','?)? '}'
spec: modname ('as' modname)?
modname: anyname | STRING
attributes: ('with' | 'assert') '{' (modname ':' STRING (',' modname ':' STRING)* ','?)? '}'
exporting: 'export' '*' ('as' modname)? 'from' STRING attributes? ';' | 'export' named ('from' STRING attributes?)? ';' | 'export' declaration
    | 'export' 'default' (function | class) | 'export' 'default' plainexpr ';'
plainexpr: assignment ![ 'function' 'class' ]
declaration: vars ';' | function | class | t_declaration
block: '{' stmt* '}'
stmt: block | ';' | vars ';' | function | class | t_declaration | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | for
    | 'continue' IDENT? ';' | 'break' IDENT? ';' | 'return' expr? ';' | 'throw' expr ';' | 'debugger' ';' | switch | try | IDENT ':' stmt | exprstmt ';'
exprstmt: expr ![ '{' 'function' 'class' ]
for: 'for' '(' (vars | expr)? ';' expr? ';' expr? ')' stmt | 'for' 'await'? '(' (varkind binding | target) ('in' expr | 'of' assignment) ')' stmt
switch: 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'
try: 'try' block ('catch' ('(' binding t_type ')')? block ('finally' block)? | 'finally' block)
varkind: 'var' | 'let' | 'const' | 'using' | 'await' 'using'
vars: ('var' | 'let') declarator (',' declarator)* | ('const' | 'using' | 'await' 'using') initialised (',' initialised)*
declarator: IDENT t_definite t_type ('=' assignment)? | initialised
initialised: binding t_type '=' assignment | t_ambient
binding: IDENT | '[' bindelem? (',' bindelem?)* ']' | '{' (bindprop (',' bindprop)* ','?)? '}'
bindelem: binding ('=' assignment)? | '...' binding
bindprop: propname ':' binding ('=' assignment)? | IDENT ('=' assignment)? | '...' binding
function: 'async'? 'function' '*'? IDENT? t_params '(' params ')' t_result t_body
params: (param (',' param)* ','?)?
param: t_modifiers binding t_optional t_type ('=' assignment)? | t_modifiers '...' binding t_type
class: t_decorators t_abstract 'class' IDENT? t_params ('extends' leftside t_args)? t_implements '{' member* '}'
member: ';' | t_decorators t_member 'static'? method | t_decorators t_member 'static'? field ';' | 'static' block | t_signature
method: (methodkind | 'async'? '*')? propname t_optional t_params '(' params ')' t_result t_body
methodkind: 'get' | 'set' | 'async'
field: 'accessor'? propname t_definite t_optional t_type ('=' assignment)?
propname: anyname | STRING | NUMBER | PRIVATE | '[' assignment ']'
expr: assignment (',' assignment)*
assignment: conditional | arrow | target '=' assignment | simple assignop assignment | 'yield' '*'? assignment?
target: simple | array | object
simple: IDENT | leftside '.' (anyname | PRIVATE) | leftside '[' expr ']' | '(' simple ')' | t_target
assignop: '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow: 'async'? (IDENT | t_params '(' params ')' t_result) '=>' arrowbody
arrowbody: assignment ![ '{' ] | '{' stmt* '}'
conditional: binary ('?' assignment ':' assignment)?
binary: unary (binop unary | t_cast)*
binop: '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**'
unary: ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await') unary | ('++' | '--' | PLUSPLUS) simple | t_angle unary | leftside | simple ('++' | '--')
leftside: primary | leftside '.' (anyname | PRIVATE) | leftside '[' expr ']' | leftside t_args arguments | leftside template | leftside t_nonnull
    | leftside '?.' (anyname | PRIVATE | '[' expr ']' | arguments) | 'new' leftside | 'new' '.' 'target' | 'import' arguments | 'import' '.' 'meta'
arguments: '(' (argument (',' argument)* ','?)? ')'
argument: '...'? assignment
primary: IDENT | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | template | PRIVATE | array | object | function | class | '(' expr ')'
template: TEMPLATE | T_OPEN expr (T_MID expr)* T_CLOSE
array: '[' argument? (',' argument?)* ']'
object: '{' (property (',' property)* ','?)? '}'
property: propname ':' assignment | IDENT ('=' assignment)? | '...' assignment | method
"""
JAVASCRIPT = SCRIPT + r"""
t_declaration: 'class' '<none>'
t_type:
t_definite:
t_optional:
t_params:
t_args:
t_result:
t_body: '{' stmt* '}'
t_modifiers:
t_decorators: ('@' leftside)*
t_abstract:
t_implements:
t_member:
t_signature: '<none>'
t_cast: '<none>'
t_angle: '<none>'
t_nonnull: '<none>'
t_target: '<none>'
t_ambient: '<none>'
"""
TYPESCRIPT = SCRIPT + r"""
t_declaration: 'declare' declaration | 'interface' IDENT t_params ('extends' typelist)? objecttype | 'type' IDENT t_params '=' type ';' | 'const'? 'enum' IDENT '{' (enumitem (',' enumitem)* ','?)? '}'
    | ('namespace' | 'module') (IDENT ('.' IDENT)* | STRING) '{' item* '}' | 'declare' 'global' '{' item* '}' | 'import' 'type'? IDENT '=' 'require' '(' STRING ')' ';' | 'import' IDENT '=' IDENT ('.' anyname)* ';'
    | 'import' 'type' imported 'from' STRING attributes? ';' | 'export' 'type' named ('from' STRING)? ';' | 'export' 'type' '*' ('as' IDENT)? 'from' STRING ';' | 'export' '=' expr ';' | 'export' 'as' 'namespace' IDENT ';' | 'abstract' class
spec: 'type' modname ('as' modname)?
enumitem: propname ('=' assignment)?
typelist: type (',' type)*
t_type: (':' type)?
t_definite: '!'?
t_optional: '?'?
t_params: ('<' (typeparam (',' typeparam)* ','?) '>')?
typeparam: ('const' | 'in' | 'out')? IDENT ('extends' type)? ('=' type)?
t_args: ('<' type (',' type)* '>')?
t_result: (':' predicate)?
predicate: type | 'asserts'? (IDENT | 'this') 'is' type | 'asserts' (IDENT | 'this')
t_body: '{' stmt* '}' | ';'
t_modifiers: (decorator | 'public' | 'private' | 'protected' | 'readonly' | 'override')*
decorator: '@' leftside
t_decorators: decorator*
t_abstract:
t_implements: ('implements' typelist)?
t_member: ('public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'static')*
t_signature: t_member '[' IDENT ':' type ']' ':' type ';'
t_cast: 'as' type | 'as' 'const' | 'satisfies' type
t_angle: '<' type '>'
t_nonnull: '!'
t_target: leftside t_nonnull | '(' expr t_cast ')' | '(' t_angle unary ')'
t_ambient: IDENT ':' type
param: 'this' ':' type
type: conditionaltype | functiontype
functiontype: t_params '(' params ')' '=>' predicate | 'abstract'? 'new' t_params '(' params ')' '=>' type
conditionaltype: uniontype ('extends' uniontype '?' type ':' type)?
uniontype: '|'? intersection ('|' intersection)*
intersection: '&'? typeop ('&' typeop)*
typeop: ('keyof' | 'unique' | 'readonly') typeop | 'infer' IDENT ('extends' typeop)? | posttype
posttype: basetype | posttype '[' ']' | posttype '[' type ']'
basetype: typename ('<' type (',' type)* '>')? | 'void' | 'null' | 'this' | 'true' | 'false' | STRING | '-'? NUMBER | TEMPLATE | T_OPEN type (T_MID type)* T_CLOSE | 'typeof' typename ('<' type (',' type)* '>')? | 'typeof' 'import' '(' type ')'
    | 'import' '(' type ')' ('.' anyname)* ('<' type (',' type)* '>')? | '(' type ')' | '[' (tupleitem (',' tupleitem)* ','?)? ']' | objecttype | mappedtype
typename: IDENT ('.' anyname)*
tupleitem: type '?'? | '...' type | '...'? anyname '?'? ':' type
objecttype: '{' (typemember (',' | ';')?)* '}'
typemember: 'readonly'? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? t_params '(' params ')' t_result | t_params '(' params ')' t_result | 'new' t_params '(' params ')' t_result | ('readonly' | '-' 'readonly' | '+' 'readonly')? '[' IDENT ':' type ']' ':' type
mappedtype: '{' (('+' | '-')? 'readonly')? '[' IDENT 'in' type ('as' type)? ']' (('+' | '-')? '?')? ':' type ';'? '}'
"""

JAVA_RESERVED = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import
instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile
while true false null"""
JAVA = r"""
start: (annotation* 'package' dotted ';')? importing* typedecl* | annotation* 'open'? 'module' dotted '{' directive* '}'
directive: IDENT+ dotted (IDENT dotted (',' dotted)*)? ';'
importing: 'import' 'static'? dotted ('.' '*')? ';' | ';'
dotted: IDENT ('.' IDENT)*
typedecl: modifier* (class | interface | enum | record | annotationtype) | ';'
modifier: annotation | 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
annotation: '@' dotted ('(' (elementvalue | IDENT '=' elementvalue (',' IDENT '=' elementvalue)*)? ')')?
elementvalue: conditional | annotation | '{' (elementvalue (',' elementvalue)*)? ','? '}'
class: 'class' IDENT typeparams? ('extends' type)? ('implements' types)? ('permits' types)? body
interface: 'interface' IDENT typeparams? ('extends' types)? ('permits' types)? body
enum: 'enum' IDENT ('implements' types)? '{' (enumitem (',' enumitem)*)? ','? (';' member*)? '}'
enumitem: annotation* IDENT arguments? body?
record: 'record' IDENT typeparams? '(' (component (',' component)*)? ')' ('implements' types)? body
component: annotation* type '...'? IDENT
annotationtype: '@' 'interface' IDENT '{' (modifier* type IDENT '(' ')' dims? ('default' elementvalue)? ';' | modifier* type declarators ';' | typedecl)* '}'
typeparams: '<' typeparam (',' typeparam)* '>'
typeparam: annotation* IDENT ('extends' type ('&' type)*)?
types: type (',' type)*
body: '{' member* '}'
member: typedecl | 'static'? block | modifier* typeparams? (type | 'void') IDENT '(' params ')' dims? ('throws' types)? (block | ';') | modifier* typeparams? IDENT '(' params ')' ('throws' types)? block | modifier* IDENT block
    | modifier* type declarators ';'
params: (param (',' param)*)?
param: parammod* type '...'? IDENT dims? | parammod* type (IDENT '.')? 'this'
parammod: annotation | 'final'
type: annotation* (primitive | classtype) dims?
primitive: 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double'
classtype: IDENT typeargs? ('.' annotation* IDENT typeargs?)*
typeargs: '<' (typearg (',' typearg)*)? '>'
typearg: type | annotation* '?' (('extends' | 'super') type)?
dims: (annotation* '[' ']')+
declarators: declarator (',' declarator)*
declarator: IDENT dims? ('=' (expr | arrayinit))?
arrayinit: '{' ((expr | arrayinit) (',' (expr | arrayinit))*)? ','? '}'
block: '{' blockstmt* '}'
blockstmt: localvars ';' | parammod* ('abstract' | 'static' | 'strictfp')* (class | interface | enum | record) | stmt
localvars: parammod* type declarators
stmt: block | ';' | IDENT ':' stmt | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | 'switch' '(' expr ')' switchbody | 'return' expr? ';' | 'break' IDENT? ';'
    | 'continue' IDENT? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | try | stmtexpr ';'
for: 'for' '(' (localvars | stmtexprs)? ';' expr? ';' stmtexprs? ')' stmt | 'for' '(' parammod* type IDENT ':' expr ')' stmt
stmtexprs: stmtexpr (',' stmtexpr)*
stmtexpr: assignment | ('++' | '--') target | target ('++' | '--') | call | creation
switchbody: '{' (labels+ blockstmt*)* '}' | '{' (caselabel '->' (expr ';' | block | 'throw' expr ';'))+ '}'
labels: caselabel ':'
caselabel: 'case' casevalue (',' casevalue)* ('when' expr)? | 'default'
casevalue: conditional | pattern | 'default'
pattern: parammod* type IDENT | type '(' (pattern (',' pattern)*)? ')' IDENT?
try: 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' parammod* type ('|' type)* IDENT ')' block)* ('finally' block)?
resource: parammod* type IDENT '=' expr | postfix
expr: assignment | conditional | lambda
assignment: target assignop expr
target: IDENT | primary '.' IDENT | primary '[' expr ']' | '(' target ')'
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
lambda: (IDENT | '(' (IDENT (',' IDENT)*)? ')' | '(' params ')') '->' (expr | block)
conditional: binary ('?' expr ':' (conditional | lambda))?
binary: unary (binop unary | 'instanceof' (parammod* type | pattern))*
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
unary: ('+' | '-' | '!' | '~') unary | ('++' | '--') target | '(' type ('&' type)* ')' (unary | lambda) | postfix | target ('++' | '--')
postfix: primary
primary: NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | IDENT | '(' expr ')' | primary '.' IDENT | primary '.' 'this' | primary '.' 'super' | primary '[' expr ']' | call | creation | (type | 'void') '.' 'class'
    | (primary | type) '::' typeargs? (IDENT | 'new') | 'switch' '(' expr ')' switchbody
call: primary arguments | primary '.' typeargs IDENT arguments
arguments: '(' (expr (',' expr)*)? ')'
creation: (primary '.')? 'new' typeargs? annotation* classtype arguments body? | 'new' annotation* (primitive | classtype) (('[' expr ']')+ dims? | dims arrayinit)
"""

GO_RESERVED = """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"""
GO = r"""
start: 'package' IDENT ';' (importing ';')* (topdecl ';')*
importing: 'import' (importspec | '(' (importspec ';')* importspec? ')')
importspec: ('.' | IDENT)? STRING
topdecl: decl | 'func' IDENT typeparams? signature block? | 'func' parameters IDENT signature block?
decl: 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')') | 'var' (varspec | '(' (varspec ';')* varspec? ')')
constspec: idents (type? '=' exprs)?
typespec: IDENT typeparams? '='? type
varspec: idents (type ('=' exprs)? | '=' exprs)
idents: IDENT (',' IDENT)*
typeparams: '[' typeparam (',' typeparam)* ','? ']'
typeparam: idents constraint
constraint: union
union: tilde ('|' tilde)*
tilde: '~'? type
type: typename typeargs? | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' signature | structtype | interfacetype | '(' type ')'
typename: IDENT ('.' IDENT)?
typeargs: '[' type (',' type)* ','? ']'
structtype: 'struct' '{' (field ';')* field? '}'
field: (idents type | '*'? typename typeargs?) STRING?
interfacetype: 'interface' '{' (element ';')* element? '}'
element: IDENT signature | union
signature: parameters (parameters | type)?
parameters: '(' (parameter (',' parameter)* ','?)? ')'
parameter: IDENT? '...'? type
block: '{' stmts '}'
stmts: (stmt? ';')* stmt?
stmt: decl | IDENT ':' stmt? | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' IDENT? | 'continue' IDENT? | 'goto' IDENT | 'fallthrough' | block | if | switch | select | for
simple: expr | expr '<-' expr | expr ('++' | '--') | exprs assignop exprs | exprs ':=' exprs
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if: 'if' (simple? ';')? expr block ('else' (if | block))?
switch: 'switch' (simple? ';')? expr? '{' case* '}' | 'switch' (simple? ';')? (IDENT ':=')? primary '.' '(' 'type' ')' '{' typecase* '}'
case: ('case' exprs | 'default') ':' stmts
typecase: ('case' type (',' type)* | 'default') ':' stmts
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
for: 'for' (expr | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr)? block
exprs: expr (',' expr)*
expr: unary (binop unary)*
binop: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary
primary: NUMBER | STRING | CHAR | IDENT | '(' expr ')' | '(' type ')' | 'func' signature block | literal | primary '.' IDENT | primary '.' '(' type ')' | primary '[' index ']' | primary '(' (callarg (',' callarg)* '...'? ','?)? ')' | converted '(' expr ','? ')'
converted: '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | 'func' signature | 'interface' '{' '}' | structtype
callarg: expr | type
index: expr (',' type)* ','? | type (',' type)* ','? | expr? ':' expr? | expr? ':' expr ':' expr
literal: literaltype literalvalue
literaltype: typename typeargs? | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | structtype
literalvalue: '{' (keyed (',' keyed)* ','?)? '}'
keyed: (value ':')? value
value: expr | literalvalue
"""

CSHARP_RESERVED = """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for
foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof
stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"""
CSHARP = r"""
start: extern* using* globalattr* top*
top: stmt | nsmember
extern: 'extern' 'alias' IDENT ';'
using: 'global'? 'using' 'static'? typename ';' | 'global'? 'using' IDENT '=' type ';'
globalattr: '[' ('assembly' | 'module') ':' attribute (',' attribute)* ','? ']'
nsmember: 'namespace' dotted '{' extern* using* nsmember* '}' ';'? | 'namespace' dotted ';' using* | typedecl
dotted: IDENT ('.' IDENT)*
attributes: ('[' (anyname ':')? attribute (',' attribute)* ','? ']')*
attribute: typename ('(' (attrarg (',' attrarg)*)? ')')?
attrarg: (IDENT ('=' | ':'))? expr
modifier: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'partial' | 'async' | 'required' | 'file' | 'const' | 'ref' | 'fixed'
typedecl: attributes modifier* (class | enum | 'delegate' reftype IDENT typeparams? '(' params ')' where* ';')
class: ('class' | 'struct' | 'interface' | 'record' | 'record' 'class' | 'record' 'struct') IDENT typeparams? ('(' params ')')? (':' basetype (',' basetype)*)? where* ('{' member* '}' ';'? | ';')
basetype: type arguments?
enum: 'enum' IDENT (':' type)? '{' (enumitem (',' enumitem)*)? ','? '}' ';'?
enumitem: attributes IDENT ('=' expr)?
typeparams: '<' typeparam (',' typeparam)* '>'
typeparam: attributes ('in' | 'out')? IDENT
where: 'where' IDENT ':' constraint (',' constraint)*
constraint: type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default'
member: typedecl | attributes modifier* memberbody
memberbody: reftype declarators ';' | reftype membername typeparams? '(' params ')' where* funcbody | IDENT '(' params ')' (':' ('base' | 'this') arguments)? funcbody | '~' IDENT '(' ')' funcbody
    | reftype membername propbody | reftype (typename '.')? 'this' '[' params ']' propbody | 'event' type declarators ';' | 'event' type membername '{' accessor* '}'
    | reftype 'operator' 'checked'? operator '(' params ')' funcbody | ('implicit' | 'explicit') 'operator' 'checked'? type '(' params ')' funcbody
membername: IDENT | typename '.' IDENT
operator: '+' | '-' | '!' | '~' | '++' | '--' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'true' | 'false'
propbody: '{' accessor+ '}' ('=' init ';')? | '=>' expr ';'
accessor: attributes modifier* ('get' | 'set' | 'init' | 'add' | 'remove') funcbody
funcbody: block | '=>' expr ';' | ';'
params: (param (',' param)*)?
param: attributes ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type IDENT ('=' expr)? | '__arglist'
reftype: 'ref'? 'readonly'? type
type: basic suffix*
suffix: '?' | '*' | '[' ','* ']'
basic: typename | 'void' | 'bool' | 'byte' | 'sbyte' | 'short' | 'ushort' | 'int' | 'uint' | 'long' | 'ulong' | 'char' | 'float' | 'double' | 'decimal' | 'string' | 'object' | '(' tupletype (',' tupletype)+ ')'
    | 'delegate' '*' IDENT? '<' type (',' type)* '>'
tupletype: type IDENT?
typename: (IDENT '::')? IDENT typeargs? ('.' IDENT typeargs?)*
typeargs: '<' (type (',' type)*) '>' | '<' ','* '>'
declarators: declarator (',' declarator)*
declarator: IDENT ('[' expr ']')? ('=' init)?
init: expr | arrayinit | 'stackalloc' type? '[' expr? ']' arrayinit?
arrayinit: '{' (init (',' init)*)? ','? '}'
block: '{' stmt* '}'
stmt: block | ';' | IDENT ':' stmt | ('const' | 'ref' 'readonly'? | 'scoped')? type declarators ';' | attributes ('static' | 'async' | 'unsafe' | 'extern')* reftype IDENT typeparams? '(' params ')' where* funcbody | 'if' '(' expr ')' stmt ('else' stmt)?
    | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (type declarators | exprs)? ';' expr? ';' exprs? ')' stmt | 'await'? 'foreach' '(' ('ref' 'readonly'?)? (type IDENT | expr) 'in' expr ')' stmt
    | 'switch' '(' expr ')' '{' (label+ stmt+)* '}' | 'break' ';' | 'continue' ';' | 'return' ('ref'? expr)? ';' | 'throw' expr? ';' | 'goto' (IDENT | 'case' expr | 'default') ';' | try | 'lock' '(' expr ')' stmt
    | 'await'? 'using' '(' (type declarators | expr) ')' stmt | 'await'? 'using' type declarators ';' | 'yield' ('return' expr | 'break') ';' | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' type declarators ')' stmt | stmtexpr ';'
stmtexpr: assignment | ('++' | '--') unary | primary ('++' | '--') | call | 'await' unary | 'new' creation
label: 'case' pattern ('when' expr)? ':' | 'default' ':'
try: 'try' block ('catch' ('(' type IDENT? ')')? ('when' '(' expr ')')? block)* ('finally' block)?
exprs: expr (',' expr)*
expr: assignment | conditional | lambda | query | 'throw' expr | 'ref' expr
assignment: unary assignop (expr | arrayinit)
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '??='
lambda: attributes ('static' | 'async')* (type)? (IDENT | '(' params ')' | '(' lambdanames ')') '=>' (expr | block) | 'static'? 'async'? 'delegate' ('(' params ')')? block
lambdanames: (('ref' | 'out' | 'in')? IDENT (',' ('ref' | 'out' | 'in')? IDENT)*)?
conditional: binary ('?' expr ':' expr)?
binary: unary (binop unary | ('is' | 'as') pattern | 'switch' '{' (arm (',' arm)* ','?)? '}' | 'with' '{' (IDENT '=' expr (',' IDENT '=' expr)* ','?)? '}')*
binop: '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '..'
arm: pattern ('when' expr)? '=>' expr
pattern: simplepat (('and' | 'or') simplepat)*
simplepat: 'not' simplepat | type | type IDENT | shifted | ('<' | '>' | '<=' | '>=') shifted | '(' (subpat (',' subpat)*)? ')' | type? '(' (subpat (',' subpat)*)? ')' ('{' (subpat (',' subpat)* ','?)? '}')? IDENT? | type? '{' (subpat (',' subpat)* ','?)? '}' IDENT?
    | '[' (subpat (',' subpat)* ','?)? ']' IDENT? | '..' pattern?
shifted: unary (('+' | '-' | '*' | '/' | '%' | '<<' | '|' | '&') unary)*
subpat: (dotted ':')? pattern
unary: ('+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | 'await' | '..') unary | '(' type ')' unary | primary ('++' | '--' | '!')* | '..'
primary: NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' | 'base' | IDENT | genericname | '(' expr ')' | '(' tuplearg (',' tuplearg)+ ')' | primary '.' IDENT | primary '.' genericname | primary '!' '.' IDENT | primary '?' '.' IDENT | primary '?' '.' genericname | primary '->' IDENT | primary '!'? '[' args ']'
    | primary '?' '[' args ']' | call | 'new' creation | 'typeof' '(' type ')' | 'sizeof' '(' type ')' | 'default' ('(' type ')')? | ('checked' | 'unchecked') '(' expr ')' | IDENT '::' IDENT | prim '.' IDENT | 'nameof' '(' expr ')' | '[' (collection (',' collection)* ','?)? ']' | 'stackalloc' type? '[' expr? ']' arrayinit?
collection: expr | '..' expr
prim: 'bool' | 'byte' | 'sbyte' | 'short' | 'ushort' | 'int' | 'uint' | 'long' | 'ulong' | 'char' | 'float' | 'double' | 'decimal' | 'string' | 'object'
genericname: IDENT '<' type (',' type)* '>'
call: primary '!'? arguments
tuplearg: (IDENT ':')? expr | type IDENT
arguments: '(' args? ')'
args: arg (',' arg)*
arg: (IDENT ':')? ('ref' | 'in')? expr | (IDENT ':')? 'out' (expr | type IDENT)
creation: type arguments initializer? | type initializer | arguments initializer? | type '[' exprs ']' suffix* arrayinit? | '[' ','* ']' arrayinit | initializer
initializer: '{' (element (',' element)*)? ','? '}'
element: expr | arrayinit | IDENT '=' (expr | initializer) | '[' args ']' '=' (expr | initializer)
query: 'from' type? IDENT 'in' expr clause* ('select' expr | 'group' expr 'by' expr) ('into' IDENT clause* ('select' expr | 'group' expr 'by' expr))?
clause: 'from' type? IDENT 'in' expr | 'let' IDENT '=' expr | 'where' expr | 'join' type? IDENT 'in' expr 'on' expr 'equals' expr ('into' IDENT)? | 'orderby' ordering (',' ordering)*
ordering: expr ('ascending' | 'descending')?
"""

RUST_RESERVED = """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe
use where while"""
RUST = r"""
start: ('#' '!' '[' tokens ']')* item*
item: attr* visibility? itembody | macroitem
attr: '#' '!'? '[' tokens ']'
visibility: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?
itembody: 'use' usetree ';' | 'extern' 'crate' (IDENT | 'self') ('as' IDENT)? ';' | 'mod' IDENT (';' | '{' ('#' '!' '[' tokens ']')* item* '}') | function | 'struct' IDENT generics? where? ('{' fields '}' | ';') | 'struct' IDENT generics? '(' tuplefields ')' where? ';'
    | 'union' IDENT generics? where? '{' fields '}' | 'enum' IDENT generics? where? '{' (variant (',' variant)* ','?)? '}' | 'unsafe'? 'trait' IDENT generics? (':' bounds?)? where? '{' associated* '}' | 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' associated* '}'
    | 'type' IDENT generics? (':' bounds)? where? ('=' type)? ';' | 'const' (IDENT) ':' type ('=' expr)? ';' | 'static' 'mut'? IDENT ':' type ('=' expr)? ';' | 'unsafe'? 'extern' STRING? '{' item* '}'
macroitem: attr* path '!' IDENT? (delimited ';' | '{' tokens '}')
associated: attr* visibility? 'default'? itembody | macroitem
usetree: ('::'? path '::')? ('*' | '{' (usetree (',' usetree)* ','?)? '}') | '::'? path ('as' IDENT)? | '::' '{' (usetree (',' usetree)* ','?)? '}'
function: qualifier* 'fn' IDENT generics? '(' fnparams ')' ('->' type)? where? (block | ';')
qualifier: 'const' | 'async' | 'unsafe' | 'extern' STRING?
fnparams: (fnparam (',' fnparam)* ','?)?
fnparam: attr* ('&' LIFETIME?)? 'mut'? 'self' (':' type)? | attr* pattern ':' type | attr* '...'
fields: (field (',' field)* ','?)?
field: attr* visibility? IDENT ':' type
tuplefields: (tuplefield (',' tuplefield)* ','?)?
tuplefield: attr* visibility? type
variant: attr* visibility? IDENT ('{' fields '}' | '(' tuplefields ')')? ('=' expr)?
generics: '<' (generic (',' generic)* ','?)? '>'
generic: attr* LIFETIME (':' lifebounds?)? | attr* IDENT (':' bounds?)? ('=' type)? | attr* 'const' IDENT ':' type ('=' constarg)?
lifebounds: LIFETIME ('+' LIFETIME)*
where: 'where' (clause (',' clause)* ','?)?
clause: LIFETIME ':' lifebounds? | forlife? type ':' bounds?
forlife: 'for' generics
bounds: bound ('+' bound)* '+'?
bound: LIFETIME | ('?' | '~' 'const')? forlife? typepath | '(' ('?')? forlife? typepath ')'
type: typepath | '(' ')' | '(' type ')' | '(' type (',' type)+ ','? ')' | '(' type ',' ')' | '!' | '&' LIFETIME? 'mut'? type | '&&' LIFETIME? 'mut'? type | '*' ('const' | 'mut') type | '[' type ']' | '[' type ';' expr ']' | forlife? qualifier* 'fn' '(' (fntype (',' fntype)* ','?)? ')' ('->' type)?
    | 'dyn' bounds | 'impl' bounds | '_' | path '!' delimited | '<' type ('as' typepath)? '>' '::' typepath
fntype: (IDENT ':' | '_' ':')? type | '...'
typepath: '::'? typeseg ('::' typeseg)*
typeseg: segname ('::'? typeargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
segname: IDENT | 'self' | 'Self' | 'super' | 'crate'
typeargs: '<' (typearg (',' typearg)* ','?)? '>'
typearg: LIFETIME | type | constarg | IDENT typeargs? '=' type | IDENT typeargs? ':' bounds
constarg: '-'? NUMBER | STRING | CHAR | 'true' | 'false' | block
path: segname ('::' segname)*
block: '{' innerattr stmt* tail? '}'
innerattr: ('#' '!' '[' tokens ']')*
stmt: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blockexpr
tail: attr* expr
expr: binary | range | closure | jump | binary assignop expr | attr+ expr
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
range: binary ('..' | '..=') rangeend? | ('..' | '..=') rangeend?
rangeend: binary | closure
jump: 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME?
closure: 'static'? 'async'? 'move'? ('|' (cparam (',' cparam)* ','?)? '|' | '||') ('->' type block | expr)
cparam: attr* patternnoalt (':' type)?
binary: cast (binop (cast | closure | jump))*
binop: '||' | '&&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '|' | '^' | '&' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%'
cast: unary ('as' type)*
unary: ('-' | '*' | '!') unary | ('&' | '&&') ('mut' | 'raw' 'const' | 'raw' 'mut')? unary | postfix | 'let' pattern '=' unary
postfix: primary | postfix '?' | postfix '.' 'await' | postfix '.' (IDENT | NUMBER) | postfix '.' IDENT '::' typeargs | postfix '(' exprs ')' | postfix '[' expr ']'
exprs: (expr (',' expr)* ','?)?
primary: NUMBER | STRING | CHAR | 'true' | 'false' | exprpath | '(' expr ')' | '(' ')' | '(' expr ',' exprs ')' | '[' exprs ']' | '[' expr ';' expr ']' | exprpath '{' (fieldinit (',' fieldinit)* (',' ('..' expr?)?)?)? '}' | exprpath '{' '..' expr '}' | path '!' delimited | blockexpr | '_'
exprpath: '::'? exprseg ('::' exprseg)* | '<' type ('as' typepath)? '>' ('::' exprseg)+
exprseg: segname | typeargs
fieldinit: attr* (IDENT | NUMBER) (':' expr)? | attr* IDENT '!' delimited
blockexpr: block | (LIFETIME ':')? ('loop' block | 'while' expr block | 'for' pattern 'in' expr block | block) | 'unsafe' block | 'async' 'move'? block | 'const' block | if | 'match' expr '{' innerattr arms '}' | path '!' '{' tokens '}'
if: 'if' expr block ('else' (block | if))?
arms: arm*
arm: attr* pattern ('if' expr)? '=>' (expr ',' | expr | blockexpr ','?)
pattern: '|'? patternnoalt ('|' patternnoalt)*
patternnoalt: literal | literal? ('..' | '..=' | '...') literal? | 'ref'? 'mut'? IDENT ('@' patternnoalt)? | '_' | '..' | ('&' | '&&') 'mut'? patternnoalt | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | exprpath | exprpath '(' (pattern (',' pattern)* ','?)? ')' | exprpath '{' (fieldpat (',' fieldpat)* ','?)? '}' | path '!' delimited | 'box' patternnoalt | 'const' block
literal: '-'? NUMBER | STRING | CHAR | 'true' | 'false' | exprpath
fieldpat: attr* (IDENT | NUMBER) ':' pattern | attr* 'ref'? 'mut'? IDENT | attr* '..'
delimited: '(' tokens ')' | '[' tokens ']' | '{' tokens '}'
tokens: tree*
tree: anytoken | delimited | '$' | '~' | '\\'
"""

PHP_RESERVED = """abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final
finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw
trait try unset use var while xor yield"""
PHP = r"""
start: stmt*
stmt: block | ';' | ECHO_TAG exprs ';'? | 'if' '(' expr ')' stmt ('elseif' '(' expr ')' stmt)* ('else' stmt)? | 'if' '(' expr ')' ':' stmt* ('elseif' '(' expr ')' ':' stmt*)* ('else' ':' stmt*)? 'endif' ';' | 'while' '(' expr ')' (stmt | ':' stmt* 'endwhile' ';')
    | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' exprs? ';' exprs? ';' exprs? ')' (stmt | ':' stmt* 'endfor' ';') | 'foreach' '(' expr 'as' (eachvar '=>')? eachvar ')' (stmt | ':' stmt* 'endforeach' ';')
    | 'switch' '(' expr ')' ('{' ';'? case* '}' | ':' case* 'endswitch' ';') | 'break' NUMBER? ';' | 'continue' NUMBER? ';' | 'return' expr? ';' | 'global' VAR (',' VAR)* ';' | 'static' staticvar (',' staticvar)* ';' | 'echo' exprs ';' | 'unset' '(' exprs ','? ')' ';'
    | 'declare' '(' IDENT '=' expr (',' IDENT '=' expr)* ')' (stmt | ':' stmt* 'enddeclare' ';') | try | 'goto' IDENT ';' | IDENT ':' | 'const' constitem (',' constitem)* ';' | 'namespace' IDENT? (';' | block) | 'use' ('function' | 'const')? useitem (',' useitem)* ';'
    | function | classdecl | expr ';' | '__halt_compiler' '(' ')' ';'
block: '{' stmt* '}'
eachvar: '&'? expr
staticvar: VAR ('=' expr)?
constitem: anyname '=' expr
useitem: IDENT ('as' IDENT)? | IDENT '\\' '{' groupitem (',' groupitem)* ','? '}'
groupitem: ('function' | 'const')? IDENT ('as' IDENT)?
case: ('case' expr | 'default') (':' | ';') stmt*
try: 'try' block ('catch' '(' IDENT ('|' IDENT)* VAR? ')' block)* ('finally' block)?
attributes: ('#[' attribute (',' attribute)* ','? ']')*
attribute: IDENT arguments?
function: attributes 'function' '&'? (IDENT | 'readonly') '(' params ')' result block
params: (param (',' param)* ','?)?
param: attributes parammod* type? '&'? '...'? VAR ('=' expr)? hooks?
parammod: 'public' | 'private' | 'protected' | 'readonly'
result: (':' type)?
type: '?'? single | single ('|' single)+ | single ('&' single)+ | union
union: unionpart ('|' unionpart)+
unionpart: single | '(' single ('&' single)+ ')'
single: IDENT | 'array' | 'callable' | 'static'
classdecl: attributes ('abstract' | 'final' | 'readonly')* 'class' IDENT ('extends' IDENT)? ('implements' names)? body | attributes 'interface' IDENT ('extends' names)? body | attributes 'trait' IDENT body | attributes 'enum' IDENT (':' type)? ('implements' names)? body
names: IDENT (',' IDENT)*
body: '{' member* '}'
member: 'use' names (';' | '{' adaptation* '}') | attributes memmod* 'const' type? constitem (',' constitem)* ';' | attributes memmod+ type? property (',' property)* ';' | attributes memmod+ type? VAR ('=' expr)? hooks | attributes memmod* 'function' '&'? anyname '(' params ')' result (block | ';') | attributes 'case' anyname ('=' expr)? ';'
memmod: 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'readonly' | 'var'
property: VAR ('=' expr)?
hooks: '{' (attributes 'final'? '&'? IDENT ('(' params ')')? (block | '=>' expr ';' | ';'))+ '}'
adaptation: (IDENT '::')? anyname 'as' parammod? anyname ';' | (IDENT '::')? anyname 'as' parammod ';' | IDENT '::' anyname 'insteadof' names ';'
exprs: expr (',' expr)*
expr: binary | binary '?' expr? ':' expr | unary assignop '&'? expr | prefixed
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??='
prefixed: ('print' | 'include' | 'include_once' | 'require' | 'require_once' | 'throw') expr | 'yield' (expr ('=>' expr)?)? | 'yield' 'from' expr | 'clone' expr | attributes 'static'? 'fn' '&'? '(' params ')' result '=>' expr
binary: unary (binop (unary | prefixed | unary assignop '&'? expr))*
binop: '||' | '&&' | 'or' | 'and' | 'xor' | '??' | '|' | '^' | '&' | '==' | '!=' | '<>' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>>' | '+' | '-' | '.' | '*' | '/' | '%' | '**' | 'instanceof' | '|>'
unary: ('!' | '~' | '+' | '-' | '@' | '&' | '++' | '--' | CAST) unary | ('!' | '-' | '@') prefixed | postfix ('++' | '--')?
postfix: primary | postfix '[' expr? ']' | postfix '{' expr '}' | postfix ('->' | '?->') propname | postfix '::' (VAR | anyname | 'class' | '{' expr '}' | '$' postfix) | postfix arguments
propname: anyname | VAR | '{' expr '}'
arguments: '(' (argument (',' argument)* ','?)? ')' | '(' '...' ')'
argument: '...'? expr | anyname ':' expr
primary: NUMBER | STRING | VAR | '$' primary | '$' '{' expr '}' | IDENT | 'static' | '(' expr ')' | array | ('isset' | 'empty') '(' exprs ','? ')' | 'list' '(' (arrayitem? (',' arrayitem?)*) ')' | closure | 'new' (newtype arguments? | attributes ('readonly')* 'class' arguments? ('extends' IDENT)? ('implements' names)? body)
    | 'match' '(' expr ')' '{' (arm (',' arm)* ','?)? '}' | 'exit' ('(' expr? ')')?
newtype: IDENT | 'static' | VAR | newtype ('->' | '?->') propname | newtype '::' VAR | newtype '[' expr ']' | '(' expr ')'
array: '[' arrayitem? (',' arrayitem?)* ']' | 'array' '(' (arrayitem (',' arrayitem)* ','?)? ')'
arrayitem: (expr '=>')? '&'? expr | '...' expr
arm: (exprs ','? | 'default' ','?) '=>' expr
closure: attributes 'static'? 'function' '&'? '(' params ')' ('use' '(' ('&'? VAR (',' '&'? VAR)* ','?)? ')')? result block
"""

KOTLIN_RESERVED = """as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while"""
KOTLIN = r"""
start: fileannotation* ('package' dotted ';'?)? importing* (decl | ';')*
fileannotation: '@' 'file' ':' (single | '[' single+ ']') ';'?
importing: 'import' dotted ('.' '*' | 'as' IDENT)? ';'
dotted: IDENT ('.' IDENT)*
semi: ';'
annotation: '@' (target ':')? single | '@' (target ':')? '[' single+ ']'
target: 'field' | 'property' | 'get' | 'set' | 'receiver' | 'param' | 'setparam' | 'delegate'
single: usertype arguments?
modifier: annotation ';'? | 'public' | 'private' | 'protected' | 'internal' | 'open' | 'abstract' | 'final' | 'sealed' | 'override' | 'data' | 'inner' | 'enum' | 'annotation' | 'companion' | 'value' | 'inline' | 'tailrec' | 'operator' | 'infix' | 'external' | 'suspend' | 'const' | 'lateinit' | 'vararg' | 'noinline' | 'crossinline' | 'reified' | 'expect' | 'actual'
decl: modifier* declbody
declbody: class | object | function | property | 'typealias' IDENT typeparams? '=' type
class: ('class' | 'fun'? 'interface') IDENT typeparams? (modifier* 'constructor'? '(' cparams ')')? (':' supertypes)? where? (body | enumbody)?
cparams: (cparam (',' cparam)* ','?)?
cparam: modifier* ('val' | 'var')? IDENT ':' type ('=' expr)?
supertypes: supertype (',' supertype)*
supertype: annotation* usertype arguments? | annotation* usertype 'by' expr | functiontype
where: 'where' IDENT ':' type (',' IDENT ':' type)*
body: '{' (member | ';')* '}'
enumbody: '{' (entry (',' entry)*)? ','? (';' (member | ';')*)? '}'
entry: modifier* IDENT arguments? body?
member: decl | 'init' block | modifier* 'constructor' '(' params ')' (':' ('this' | 'super') arguments)? block?
object: 'object' IDENT? (':' supertypes)? body?
function: 'fun' typeparams? (receiver '.')? IDENT '(' params ')' (':' type)? where? (block | '=' expr)?
receiver: usertype '?'* | '(' type ')' '?'*
params: (param (',' param)* ','?)?
param: modifier* IDENT ':' type ('=' expr)?
property: ('val' | 'var') typeparams? (receiver '.')? (vardecl | multi) where? ('=' expr | 'by' expr)? (';'? accessor)*
vardecl: annotation* IDENT (':' type)?
multi: '(' vardecl (',' vardecl)* ','? ')'
accessor: modifier* ('get' | 'set') ('(' (modifier* IDENT (':' type)?)? ','? ')' (':' type)? (block | '=' expr))?
typeparams: '<' typeparam (',' typeparam)* ','? '>'
typeparam: (modifier | 'in' | 'out')* IDENT (':' type)?
type: typemod* (usertype | '(' type ')' | functiontype) '?'* | type '&' type
typemod: annotation | 'suspend'
functiontype: (usertype '?'* '.' | '(' type ')' '?'* '.')? '(' (ftparam (',' ftparam)* ','?)? ')' '->' type
ftparam: (IDENT ':')? type
usertype: IDENT typeargs? ('.' IDENT typeargs?)*
typeargs: '<' typearg (',' typearg)* ','? '>'
typearg: ('in' | 'out')? type | '*'
block: '{' stmts '}'
stmts: (stmt? semi)* stmt?
stmt: label* (decl | assignment | loop | expr)
label: IDENT '@' | annotation
assignment: postfix ('=' | '+=' | '-=' | '*=' | '/=' | '%=') expr | ('++' | '--') postfix
loop: 'for' '(' annotation* (vardecl | multi) 'in' expr ')' (control | ';')? | 'while' '(' expr ')' (control | ';') | 'do' control? 'while' '(' expr ')'
control: block | ctrlstmt
ctrlstmt: stmt ![ '{' ]
expr: binary
binary: unary (binop unary | ('is' | '!is') type | ('as' | 'as?') type)*
binop: '||' | '&&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'in' | '!in' | '?:' | '..' | '..<' | '+' | '-' | '*' | '/' | '%' | IDENT
unary: ('-' | '+' | '!' | '++' | '--') unary | label unary | postfix
postfix: primary | postfix ('++' | '--' | '!!') | postfix typeargs? arguments lambda? | postfix typeargs? lambda | postfix '[' expr (',' expr)* ','? ']' | postfix ('.' | '?.') (IDENT | 'class' | '(' expr ')') | postfix '::' (IDENT | 'class') | usertype '?'+ '::' (IDENT | 'class')
arguments: '(' (argument (',' argument)* ','?)? ')'
argument: annotation? (IDENT '=')? '*'? expr
lambda: label* '{' (lambdaparams? '->')? stmts '}'
lambdaparams: lambdaparam (',' lambdaparam)* ','?
lambdaparam: vardecl | multi (':' type)?
primary: NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | IDENT | '(' expr ')' | 'this' ('@' IDENT)? | 'super' ('<' type '>')? ('@' IDENT)? | lambda | 'suspend'? 'fun' (receiver '.')? '(' fparams ')' (':' type)? (block | '=' expr)? | modifier* 'object' (':' supertypes)? body | '[' (expr (',' expr)* ','?)? ']' | if | when | try
    | 'return' ('@' IDENT)? expr? | 'throw' expr | 'break' ('@' IDENT)? | 'continue' ('@' IDENT)? | '::' (IDENT | 'class')
fparams: (modifier* IDENT (':' type)? ('=' expr)? (',' modifier* IDENT (':' type)? ('=' expr)?)* ','?)?
if: 'if' '(' expr ')' (control | ';') | 'if' '(' expr ')' control? ';'? 'else' (control | ';')
when: 'when' ('(' (annotation* 'val' vardecl '=')? expr ')')? '{' (whenentry | ';')* '}'
whenentry: condition (',' condition)* ','? ('if' expr)? '->' control | 'else' '->' control
condition: expr | ('in' | '!in') expr | ('is' | '!is') type
try: 'try' block ((';')? 'catch' '(' annotation* IDENT ':' type ','? ')' block)* ((';')? 'finally' block)?
"""

SQL_RESERVED = """select from where group having union intersect except insert into values update delete create table drop alter order limit and or not null in is as on join inner outer cross case when then
else end distinct between like exists primary foreign references unique check default constraint set cast using all"""
SQL = r"""
start: (stmt? ';')* stmt?
stmt: query | insert | update | delete | create | drop | alter | transaction | 'explain' anyname* stmt | merge | 'truncate' 'table'? name (',' name)* | grant | 'use' name | 'set' settings | 'comment' 'on' anyname name 'is' (STRING | 'null') | 'analyze' name? | 'vacuum' name? | 'call' name '(' exprs? ')' | 'show' anyname+ | ('describe' | 'desc') name | 'pragma' name ('=' expr | '(' expr ')')?
transaction: ('begin' | 'commit' | 'rollback' | 'end') ('transaction' | 'work' | 'tran')? ('to' 'savepoint'? IDENT)? | 'start' 'transaction' | 'savepoint' IDENT | 'release' 'savepoint'? IDENT
settings: ('session' | 'local' | 'global')? IDENT ('.' IDENT)* ('=' | 'to' | ':=') exprs
grant: ('grant' | 'revoke') privilege (',' privilege)* 'on' anyname* name ('to' | 'from') name (',' name)* ('with' 'grant' 'option')?
privilege: anyname+ columns?
name: IDENT ('.' IDENT)*
columns: '(' IDENT (',' IDENT)* ')'
query: with? queryexpr order? limits
with: 'with' 'recursive'? cte (',' cte)*
cte: IDENT columns? 'as' (('not')? 'materialized')? '(' stmt ')'
queryexpr: querypart (('union' | 'intersect' | 'except' | 'minus') ('all' | 'distinct')? querypart)*
querypart: select | '(' query ')' | 'values' row (',' row)* | 'table' name
row: '(' exprs ')'
select: 'select' ('all' | 'distinct' ('on' '(' exprs ')')? | 'top' '('? NUMBER ')'? 'percent'?)? items ('into' name)? ('from' sources)? ('where' expr)? ('group' 'by' ('all' | groupings))? ('having' expr)? ('window' IDENT 'as' window (',' IDENT 'as' window)*)? ('qualify' expr)?
groupings: grouping (',' grouping)*
grouping: expr | ('rollup' | 'cube') '(' exprs ')' | 'grouping' 'sets' '(' grouping (',' grouping)* ')' | '(' ')'
items: item (',' item)*
item: '*' | name '.' '*' | expr ('as'? alias)?
alias: IDENT | STRING
sources: source (',' source)*
source: relation (jointype? 'join' relation (('on' expr) | 'using' columns)?)*
jointype: 'natural'? ('inner' | ('left' | 'right' | 'full') ('outer' | 'semi' | 'anti')? | 'cross' | 'asof' | 'semi' | 'anti') | 'natural'
relation: 'lateral'? (name | '(' query ')' | name '(' exprs? ')' | '(' source ')' | '(' 'values' row (',' row)* ')') ('as'? IDENT columns?)? ('tablesample' IDENT? '(' exprs ')')?
order: 'order' 'by' ('all' | sort (',' sort)*)
sort: expr ('asc' | 'desc')? ('nulls' ('first' | 'last'))?
limits: ('limit' (expr | 'all') (',' expr)?)? ('offset' expr ('row' | 'rows')?)? ('fetch' ('first' | 'next') NUMBER? ('row' | 'rows') ('only' | 'with' 'ties'))? ('for' ('update' | 'share') ('of' name)? ('nowait' | 'skip' 'locked')?)?
insert: with? ('insert' ('or' IDENT)? | 'replace') ('into' | 'overwrite')? 'table'? name ('as' IDENT)? columns? ('overriding' anyname 'value')? (query | 'default' 'values') conflict? returning?
conflict: 'on' 'conflict' (columns | 'on' 'constraint' IDENT)? 'do' ('nothing' | 'update' 'set' assigns ('where' expr)?) | 'on' 'duplicate' 'key' 'update' assigns
returning: 'returning' items
update: with? 'update' name ('as'? IDENT)? 'set' assigns ('from' sources)? ('where' expr)? returning?
assigns: assign (',' assign)*
assign: name '=' (expr | 'default') | columns '=' ('(' exprs ')' | '(' query ')')
delete: with? 'delete' 'from' name ('as'? IDENT)? ('using' sources)? ('where' expr)? returning?
merge: 'merge' 'into' name ('as'? IDENT)? 'using' relation 'on' expr whenclause+
whenclause: 'when' 'not'? 'matched' ('by' IDENT)? ('and' expr)? 'then' ('update' 'set' assigns | 'delete' | 'insert' columns? 'values' row | 'do' 'nothing')
create: 'create' ('or' 'replace')? createmod* 'table' ifnot? name ('(' element (',' element)* ','? ')')? tableoption* ('as' query)? | 'create' ('or' 'replace')? createmod* 'view' ifnot? name columns? 'as' query ('with' anyname* 'check' 'option')? | 'create' 'unique'? 'index' 'concurrently'? ifnot? IDENT? 'on' name ('using' IDENT)? '(' sort (',' sort)* ')' ('include' columns)? ('where' expr)?
    | 'create' createmod* 'sequence' ifnot? name seqoption* | 'create' ('schema' | 'database') ifnot? name | 'create' 'type' name 'as' ('enum' '(' (STRING (',' STRING)*)? ')' | '(' field (',' field)* ')') | 'create' 'extension' ifnot? name | 'create' 'domain' name 'as'? datatype columnoption*
    | 'create' ('or' 'replace')? ('function' | 'procedure') name '(' (fparam (',' fparam)*)? ')' ('returns' ('table' '(' field (',' field)* ')' | 'setof'? datatype))? foption+ | 'create' ('or' 'replace')? 'trigger' IDENT ('before' | 'after' | 'instead' 'of') event ('or' event)* 'on' name ('for' 'each'? ('row' | 'statement'))? ('when' '(' expr ')')? ('execute' ('function' | 'procedure') name '(' exprs? ')' | 'begin' (stmt ';')+ 'end')
    | 'create' ('user' | 'role') name anyname* STRING?
createmod: 'temp' | 'temporary' | 'global' | 'local' | 'unlogged' | 'external' | 'materialized' | 'recursive'
fparam: ('in' | 'out' | 'inout')? IDENT? datatype (('default' | '=') expr)?
foption: 'language' (IDENT | STRING) | 'as' STRING | 'immutable' | 'stable' | 'volatile' | 'strict' | 'security' IDENT | 'return' expr
event: 'insert' | 'delete' | 'update' ('of' IDENT (',' IDENT)*)? | 'truncate'
ifnot: 'if' 'not' 'exists'
ifexists: 'if' 'exists'
element: column | tableconstraint | 'like' name (('including' | 'excluding') anyname)* | ('index' | 'key') IDENT? '(' sort (',' sort)* ')'
column: IDENT datatype columnoption*
field: IDENT datatype
datatype: typename+ ('(' typearg (',' typearg)* ')')? ('with' 'time' 'zone' | 'without' 'time' 'zone' | 'unsigned' | 'varying' ('(' NUMBER ')')?)? ('[' NUMBER? ']')* | typename '<' datatype (',' datatype)* '>' | 'set' '(' STRING (',' STRING)* ')'
typename: IDENT ('.' IDENT)?
typearg: NUMBER | STRING | IDENT | IDENT datatype
columnoption: ('constraint' IDENT)? ('not' 'null' | 'null' | 'primary' 'key' ('asc' | 'desc')? 'autoincrement'? | 'unique' 'key'? | 'default' defaultvalue | 'check' '(' expr ')' | references | 'collate' name | 'generated' ('always' | 'by' 'default') 'as' ('identity' ('(' seqoption* ')')? | '(' expr ')' ('stored' | 'virtual')?) | 'auto_increment' | 'identity' ('(' NUMBER ',' NUMBER ')')? | 'comment' STRING | 'on' 'update' expr | 'character' 'set' IDENT)
defaultvalue: '-'? atom | '(' expr ')' | atom '::' datatype
references: 'references' name columns? ('match' anyname | 'on' ('delete' | 'update') action | 'not'? 'deferrable' | 'initially' anyname)*
action: 'cascade' | 'restrict' | 'no' 'action' | 'set' ('null' | 'default')
tableconstraint: ('constraint' IDENT)? ('primary' 'key' columns | 'unique' ('key' | 'index')? IDENT? columns | 'foreign' 'key' IDENT? columns references | 'check' '(' expr ')' | 'exclude' 'using' IDENT '(' expr 'with' '=' ')')
tableoption: IDENT '='? (IDENT | STRING | NUMBER) | 'default'? ('charset' | 'character' 'set') '='? IDENT | 'partition' 'by' IDENT? '(' exprs ')' | 'with' '(' option (',' option)* ')' | 'using' IDENT | 'inherits' '(' name (',' name)* ')' | 'without' 'rowid' | 'tablespace' IDENT
option: name ('=' (expr | 'on'))?
seqoption: ('start' 'with'? | 'increment' 'by'? | 'minvalue' | 'maxvalue' | 'cache') '-'? NUMBER | 'no' ('minvalue' | 'maxvalue' | 'cycle') | 'cycle' | 'owned' 'by' name | 'as' datatype
drop: 'drop' ('table' | 'materialized'? 'view' | 'index' 'concurrently'? | 'sequence' | 'schema' | 'database' | 'type' | 'function' | 'procedure' | 'trigger' | 'extension' | 'user' | 'role' | 'domain') ifexists? name (',' name)* ('(' (datatype (',' datatype)*)? ')')? ('on' name)? ('cascade' | 'restrict')?
alter: 'alter' ('table' | 'view' | 'index' | 'sequence' | 'schema' | 'database' | 'type') ifexists? 'only'? name alteration (',' alteration)*
alteration: 'add' 'column'? ifnot? column ('first' | 'after' IDENT)? | 'add' tableconstraint | 'add' ('index' | 'key') IDENT? columns | 'drop' 'column'? ifexists? IDENT ('cascade' | 'restrict')? | 'drop' ('constraint' | 'index' | 'key') ifexists? IDENT ('cascade' | 'restrict')? | 'drop' 'primary' 'key' | ('alter' | 'modify') 'column'? IDENT (('set' 'data')? 'type' datatype ('using' expr)? | 'set' ('default' expr | 'not' 'null') | 'drop' ('default' | 'not' 'null') | datatype columnoption*)
    | 'change' 'column'? IDENT column | 'rename' ('column'? IDENT 'to' IDENT | 'to' name | 'constraint' IDENT 'to' IDENT) | 'owner' 'to' IDENT | 'set' 'schema' IDENT | 'set' '(' option (',' option)* ')' | ('enable' | 'disable') anyname+ | 'add' 'value' ifnot? STRING | seqoption
exprs: expr (',' expr)*
expr: logic
logic: negation (('and' | 'or') negation)*
negation: 'not' negation | comparison
comparison: sum (compare sum | compare ('any' | 'some' | 'all') '(' (query | expr) ')' | 'is' 'not'? ('null' | 'true' | 'false' | 'unknown' | 'distinct' 'from' sum) | ('isnull' | 'notnull') | 'not'? 'between' 'symmetric'? sum 'and' sum | 'not'? ('like' | 'ilike' | 'rlike' | 'regexp' | 'similar' 'to' | 'glob') sum ('escape' STRING)? | 'not'? 'in' ('(' (exprs | query) ')' | name))*
compare: '=' | '==' | '<>' | '!=' | '<' | '>' | '<=' | '>=' | '~' | '~*' | '!~' | '!~*' | '@>' | '<@' | '&&' | '<=>'
sum: unary (binop unary)*
binop: '+' | '-' | '*' | '/' | '%' | '||' | '^' | '&' | '|' | '<<' | '>>' | '->' | '->>' | '#>' | '#>>' | '//'
unary: ('+' | '-' | '~') unary | postfix
postfix: atom | postfix '::' datatype | postfix '[' expr? (':' expr?)? ']' | postfix 'collate' name | postfix 'at' 'time' 'zone' atom | postfix '.' IDENT
atom: NUMBER | STRING+ | PARAM | 'null' | 'true' | 'false' | 'default' | name | '(' expr ')' | '(' expr ',' exprs ')' | '(' query ')' | 'exists' '(' query ')' | 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end' | ('cast' | 'try_cast') '(' expr 'as' datatype ')' | call | 'interval' STRING IDENT? | ('date' | 'timestamp' | 'time') STRING | 'array' '[' exprs? ']' | 'array' '(' query ')' | '[' exprs? ']' | 'extract' '(' IDENT 'from' expr ')' | 'position' '(' sum 'in' expr ')' | 'substring' '(' expr 'from' expr ('for' expr)? ')' | 'trim' '(' (('both' | 'leading' | 'trailing') expr? 'from')? expr ')' | 'row' '(' exprs? ')'
call: callname '(' ('*' | ('distinct' | 'all')? callargs order? limits)? ')' ('within' 'group' '(' order ')')? ('filter' '(' 'where' expr ')')? (('ignore' | 'respect') 'nulls')? ('over' (IDENT | window))?
callname: name | 'values' | 'exists' | 'set' | 'all'
callargs: callarg (',' callarg)*
callarg: expr | IDENT ('=>' | ':=') expr | '*'
window: '(' IDENT? ('partition' 'by' exprs)? order? (('rows' | 'range' | 'groups') (bound | 'between' bound 'and' bound) ('exclude' anyname+)?)? ')'
bound: 'unbounded' ('preceding' | 'following') | 'current' 'row' | sum ('preceding' | 'following')
"""
