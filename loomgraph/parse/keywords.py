"""Reserved words, which are no identifiers."""

KEYWORDS = {
    "python": frozenset(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
    ),
    "javascript": frozenset(
        "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield".split()
    ),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var true false nil".split()),
    "rust": frozenset(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
    ),
    "java": frozenset(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while".split()
    ),
    "c": frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()
    ),
    "ruby": frozenset(
        "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()
    ),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] | frozenset("abstract any as boolean declare enum implements interface is keyof namespace never number private protected public readonly string type unknown".split())
KEYWORDS["cpp"] = KEYWORDS["c"] | frozenset(
    "alignas alignof bool catch class constexpr const_cast decltype delete dynamic_cast explicit export false final friend mutable namespace new noexcept nullptr operator override private protected public reinterpret_cast static_cast template this throw true try typeid typename using virtual".split()
)

#: Words before a parenthesis that make it no call.
NO_CALL = frozenset("if for while switch catch return sizeof typeof function fn func def match with elif elsif unless until when and or not in super new await yield do else case synchronized alignof decltype defined?".split())
