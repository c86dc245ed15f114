"""Ready-made factor sets, as templates over the expression language."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

#: The usual candle shapes.
CANDLES = {
    "KMID": "($close-$open)/$open",
    "KLEN": "($high-$low)/$open",
    "KMID2": "($close-$open)/($high-$low+1e-12)",
    "KUP": "($high-Greater($open,$close))/$open",
    "KUP2": "($high-Greater($open,$close))/($high-$low+1e-12)",
    "KLOW": "(Less($open,$close)-$low)/$open",
    "KLOW2": "(Less($open,$close)-$low)/($high-$low+1e-12)",
    "KSFT": "(2*$close-$high-$low)/$open",
    "KSFT2": "(2*$close-$high-$low)/($high-$low+1e-12)",
}
#: Rolling families; {d} is the window.  The family of minima is called LOW, its columns MIN.
FAMILIES = {
    "ROC": "Ref($close,{d})/$close",
    "MA": "Mean($close,{d})/$close",
    "STD": "Std($close,{d})/$close",
    "BETA": "Slope($close,{d})/$close",
    "RSQR": "Rsquare($close,{d})",
    "RESI": "Resi($close,{d})/$close",
    "MAX": "Max($high,{d})/$close",
    "LOW": "Min($low,{d})/$close",
    "QTLU": "Quantile($close,{d},0.8)/$close",
    "QTLD": "Quantile($close,{d},0.2)/$close",
    "RANK": "Rank($close,{d})",
    "RSV": "($close-Min($low,{d}))/(Max($high,{d})-Min($low,{d})+1e-12)",
    "IMAX": "IdxMax($high,{d})/{d}",
    "IMIN": "IdxMin($low,{d})/{d}",
    "IMXD": "(IdxMax($high,{d})-IdxMin($low,{d}))/{d}",
    "CORR": "Corr($close,Log($volume+1),{d})",
    "CORD": "Corr($close/Ref($close,1),Log($volume/Ref($volume,1)+1),{d})",
    "CNTP": "Mean($close>Ref($close,1),{d})",
    "CNTN": "Mean($close<Ref($close,1),{d})",
    "CNTD": "Mean($close>Ref($close,1),{d})-Mean($close<Ref($close,1),{d})",
    "SUMP": "Sum(Greater($close-Ref($close,1),0),{d})/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "SUMN": "Sum(Greater(Ref($close,1)-$close,0),{d})/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "SUMD": "(Sum(Greater($close-Ref($close,1),0),{d})-Sum(Greater(Ref($close,1)-$close,0),{d}))/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "VMA": "Mean($volume,{d})/($volume+1e-12)",
    "VSTD": "Std($volume,{d})/($volume+1e-12)",
    "WVMA": "Std(Abs($close/Ref($close,1)-1)*$volume,{d})/(Mean(Abs($close/Ref($close,1)-1)*$volume,{d})+1e-12)",
    "VSUMP": "Sum(Greater($volume-Ref($volume,1),0),{d})/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
    "VSUMN": "Sum(Greater(Ref($volume,1)-$volume,0),{d})/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
    "VSUMD": "(Sum(Greater($volume-Ref($volume,1),0),{d})-Sum(Greater(Ref($volume,1)-$volume,0),{d}))/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
}
WINDOWS = (5, 10, 20, 30, 60)
LABEL = {"LABEL0": "Ref($close,-2)/Ref($close,-1)-1"}


def _column(family: str) -> str:
    return "MIN" if family == "LOW" else family


def prices(fields: Iterable[str] = ("OPEN", "HIGH", "LOW", "CLOSE", "VWAP"), windows: Iterable[int] = range(5)) -> dict[str, str]:
    """Past prices by today's close."""
    return {f"{f}{d}": (f"Ref(${f.lower()},{d})/$close" if d else f"${f.lower()}/$close") for f in fields for d in windows}


def volumes(windows: Iterable[int] = range(5)) -> dict[str, str]:
    return {f"VOLUME{d}": (f"Ref($volume,{d})/($volume+1e-12)" if d else "$volume/($volume+1e-12)") for d in windows}


def rolling(windows: Sequence[int] = WINDOWS, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> dict[str, str]:
    used = [f for f in FAMILIES if f not in exclude and (include is None or f in include)]
    return {f"{_column(f)}{d}": FAMILIES[f].format(d=d) for f in used for d in windows}


def factors158() -> dict[str, str]:
    """9 candle shapes, 4 prices and 29 families of 5 windows."""
    return CANDLES | prices(("OPEN", "HIGH", "LOW", "VWAP"), (0,)) | rolling()


def factors360() -> dict[str, str]:
    """60 slots of six fields, by the latest close and volume, the oldest first."""
    out = {}
    for field in ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP"):
        for d in range(59, -1, -1):
            out[f"{field}{d}"] = f"Ref(${field.lower()},{d})/$close" if d else f"${field.lower()}/$close"
    for d in range(59, -1, -1):
        out[f"VOLUME{d}"] = f"Ref($volume,{d})/($volume+1e-12)" if d else "$volume/($volume+1e-12)"
    return out


def intraday_factors(day_slots: int = 240) -> dict[str, str]:
    """Minute prices by the previous day's close, and volumes by a month's mean, missing ones filled by the last close."""
    traded = "If(Gt($volume,0),{x},FFillNan($close))"
    before = f"Ref(DayLast(FFillNan($close)),{day_slots})"
    out = {f.upper(): f"{traded.format(x='$' + f)}/{before}" for f in ("open", "high", "low", "close", "vwap")}
    out["VOLUME"] = f"If(IsNull($volume),0,$volume)/Ref(DayLast(Mean($volume,{day_slots * 30})),{day_slots})"
    return out


#: Fourteen factors of basic daily bars, as one benchmark task.
BENCHMARK = {
    **{k: CANDLES[k] for k in ("KMID", "KLEN", "KUP", "KLOW")},
    **rolling((20,), ("ROC", "MA", "STD", "BETA", "MAX", "LOW", "CORR", "CNTP", "SUMP", "VMA")),
}
