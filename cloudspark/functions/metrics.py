"""Distances and pseudometrics between two points.

Each function returns an SQL expression over columns ``<p>x, <p>y, <p>z`` (point), ``<p>na, <p>nb, <p>nc, <p>nw`` (its
regression plane) and ``<p>l1, <p>l2, <p>l3`` (eigenvalues, largest first) of the prefixes ``a`` and ``o``. Divisions,
logarithms and arc functions are guarded, so no expression raises an error or gives NaN.
"""

from __future__ import annotations

from collections.abc import Callable

TINY = "1.17549435e-38"


def l2(a: str = "a", b: str = "o") -> str:
    return f"sqrt(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y)+({a}z-{b}z)*({a}z-{b}z))"


def l1(a: str = "a", b: str = "o") -> str:
    return f"(abs({a}x-{b}x)+abs({a}y-{b}y)+abs({a}z-{b}z))"


def l22(a: str = "a", b: str = "o") -> str:
    return f"(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y)+({a}z-{b}z)*({a}z-{b}z))"


def ell(a: str = "a", b: str = "o", sx: float = 1.0, sy: float = 1.0, sz: float = 1.0, compat: bool = True) -> str:
    """Scaled distance. The original leaves the third axis out; ``compat=False`` takes it in."""
    dz = "0.0" if compat else f"({a}z-{b}z)*({a}z-{b}z)*{sz * sz}"
    return f"sqrt(({a}x-{b}x)*({a}x-{b}x)*{sx * sx}+({a}y-{b}y)*({a}y-{b}y)*{sy * sy}+{dz})"


def norm(p: str) -> str:
    return f"sqrt({p}na*{p}na+{p}nb*{p}nb+{p}nc*{p}nc)"


def _div(x: str, y: str, other: str = "0.0") -> str:
    return f"(CASE WHEN {y} = 0 THEN {other} ELSE ({x})/nullif({y}, 0) END)"


def _clamp(x: str) -> str:
    return f"greatest(-1.0, least(1.0, {x}))"


def _ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln(CASE WHEN {x} > 0 THEN {x} ELSE 1.0 END) ELSE -708.0 END)"


def angle(a: str = "a", b: str = "o") -> str:
    """Angle of the normals, between 0 and a right angle."""
    dot = f"abs({a}na*{b}na+{a}nb*{b}nb+{a}nc*{b}nc)"
    return f"acos({_clamp(_div(dot, f'({norm(a)}*{norm(b)})', '1.0'))})"


def plane_distance(p: str, q: str) -> str:
    """Distance of point p from the plane of q."""
    return _div(f"abs({p}x*{q}na+{p}y*{q}nb+{p}z*{q}nc+{q}nw)", norm(q))


def _line_plane(a: str, b: str, p: str) -> str:
    dot = f"abs(({b}x-{a}x)*{p}na+({b}y-{a}y)*{p}nb+({b}z-{a}z)*{p}nc)"
    return f"asin({_clamp(_div(dot, f'({l2(a, b)}*{norm(p)})'))})"


def slope(p: str) -> str:
    """Angle of the normal from the vertical, in radians."""
    return f"acos({_clamp(_div(f'{p}nc', norm(p), '1.0'))})"


def _difference(of) -> object:
    return lambda a, b: f"abs({of(a)}-{of(b)})"


def linearity(p: str) -> str:
    return _div(f"{p}l1-{p}l2", f"{p}l1")


def planarity(p: str) -> str:
    return _div(f"{p}l2-{p}l3", f"{p}l1")


def sphericity(p: str) -> str:
    return _div(f"{p}l3", f"{p}l1")


def omnivariance(p: str) -> str:
    return f"power(greatest(0.0, {p}l1*{p}l2*{p}l3), 0.3333333333333333)"


def anisotropy(p: str) -> str:
    return _div(f"{p}l1-{p}l3", f"{p}l1")


def curvature(p: str) -> str:
    return _div(f"{p}l3", f"({p}l1+{p}l2+{p}l3)")


def entropy(p: str) -> str:
    """Of the eigenvalues as they are; a term of 0 counts 0."""
    terms = [f"(CASE WHEN {p}l{i} > 0 THEN {p}l{i}*{_ln(f'{p}l{i}')} ELSE 0.0 END)" for i in (1, 2, 3)]
    return f"(-({'+'.join(terms)}))"


#: What a pseudometric adds to the distance, by name.
KERNELS = {
    "abn": angle,
    "dis": lambda a, b: f"(sin({angle(a, b)}/2.0)*{l2(a, b)})",
    "ablp": lambda a, b: f"({_line_plane(a, b, a)}+{_line_plane(a, b, b)})",
    "dfp": lambda a, b: f"sqrt(power({plane_distance(a, b)}, 2.0)+power({plane_distance(b, a)}, 2.0))",
    "lin": _difference(linearity),
    "pla": lambda a, b: f"(0.5*({planarity(a)}+{planarity(b)}))",
    "sph": _difference(sphericity),
    "omn": _difference(omnivariance),
    "ani": _difference(anisotropy),
    "cur": _difference(curvature),
    "ent": _difference(entropy),
    "ver": lambda a, b: f"(0.5*abs({_ln(slope(a))}+{_ln(slope(b))}))",
    "hor": lambda a, b: f"(0.5*({_ln(slope(a))}+{_ln(slope(b))}))",
}
DISTANCES = {"l1": l1, "l2": l2, "l22": l22, "ell": ell}
NAMES = (*DISTANCES, "geo", *KERNELS)
#: A metric of one's own: SQL from the prefixes of two points, lam, mju and power.
Metric = Callable[[str, str, float, float, float], str]


def metric(name: str | Metric, a: str = "a", b: str = "o", lam: float = 0.5, mju: float = 0.95, power: float = 1.0) -> str:
    """The named distance or pseudometric, or what a function makes of the prefixes and settings.

    A pseudometric mixes its kernel with the distance D by ``mju``; beyond ``lam`` a penalty ``mju * (D - lam)**power``
    is added, at D = lam too.
    """
    if callable(name):
        return name(a, b, lam, mju, power)
    if name in DISTANCES:
        return DISTANCES[name](a, b)
    d = l2(a, b)
    if name == "geo":
        return f"(CASE WHEN {d} < {TINY} OR {d} < {lam} THEN 0.0 ELSE {d}-{lam} END)"
    base = f"({mju}*{KERNELS[name](a, b)}+{1 - mju}*{d})"
    return f"(CASE WHEN {d} < {TINY} THEN 0.0 WHEN {d} < {lam} THEN {base} ELSE {base}+{mju}*power(greatest(0.0, {d}-{lam}), {power}) END)"


def _spread(p: str, q: str) -> str:
    xx, xy, xz, yy, yz, zz = (f"{p}{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"sqrt(((({xx}-{q})*({xx}-{q})+({yy}-{q})*({yy}-{q})+({zz}-{q})*({zz}-{q}))+2.0*({xy}*{xy}+{xz}*{xz}+{yz}*{yz}))/6.0)"


def _angle3(p: str, q: str, s: str) -> str:
    xx, xy, xz, yy, yz, zz = (f"{p}{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    det = f"(({xx}-{q})*(({yy}-{q})*({zz}-{q})-{yz}*{yz})-{xy}*({xy}*({zz}-{q})-{yz}*{xz})+{xz}*({xy}*{yz}-({yy}-{q})*{xz}))"
    return f"(acos({_clamp(_div(det, f'(2.0*{s}*{s}*{s})', '1.0'))})/3.0)"


def eigen_steps(p: str = "", out: str = "l") -> dict[str, str]:
    """Columns to add one after the other: ``<out>1`` to ``<out>3``, the eigenvalues, largest first, of the symmetric
    matrix in columns ``<p>xx, xy, xz, yy, yz, zz`` in closed form, from helpers that start with an underscore.
    """
    return {
        "_q": f"({p}xx+{p}yy+{p}zz)/3.0",
        "_s": _spread(p, "_q"),
        "_phi": _angle3(p, "_q", "_s"),
        f"{out}1": "_q+2.0*_s*cos(_phi)",
        f"{out}3": "_q+2.0*_s*cos(_phi+2.0943951023931953)",
        f"{out}2": f"3.0*_q-{out}1-{out}3",
    }


def eigenvalues(p: str = "") -> tuple[str, str, str]:
    """The same in one expression each."""
    q = f"(({p}xx+{p}yy+{p}zz)/3.0)"
    s = _spread(p, q)
    phi = _angle3(p, q, s)
    high, low = f"({q}+2.0*{s}*cos({phi}))", f"({q}+2.0*{s}*cos({phi}+2.0943951023931953))"
    return high, f"(3.0*{q}-{high}-{low})", low
