import pytest

from vellumix.functions import math

NS = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def r(x):
    return f"<m:r><m:t>{x}</m:t></m:r>"


def e(x, name="e"):
    return f"<m:{name}>{x}</m:{name}>"


CASES = [
    (r("x1.5+y"), "<mrow><mi>x</mi><mn>1.5</mn><mo>+</mo><mi>y</mi></mrow>", "x1.5+y"),
    (f"<m:f>{e(r('a'), 'num')}{e(r('bc'), 'den')}</m:f>", "<mfrac><mi>a</mi><mrow><mi>b</mi><mi>c</mi></mrow></mfrac>", "a/(bc)"),
    (f"<m:sSubSup>{e(r('x'))}{e(r('i'), 'sub')}{e(r('2'), 'sup')}</m:sSubSup>", "<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>", "x_i^2"),
    (f"<m:rad><m:radPr><m:degHide m:val='1'/></m:radPr><m:deg/>{e(r('x'))}</m:rad>", "<msqrt><mi>x</mi></msqrt>", "√(x)"),
    (f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr>{e(r('i'), 'sub')}{e(r('n'), 'sup')}{e(r('i'))}</m:nary>", "<mrow><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><mi>i</mi></mrow>", "∑_i^n i"),
    (f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=''/></m:dPr>{e(r('x'))}{e(r('y'))}</m:d>", "<mrow><mo>[</mo><mi>x</mi><mo>|</mo><mi>y</mi><mo></mo></mrow>", "[x|y"),
    (f"<m:m><m:mr>{e(r('1'))}{e(r('2'))}</m:mr><m:mr>{e(r('3'))}{e(r('4'))}</m:mr></m:m>", "<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable>", "[1,2;3,4]"),
    (f"<m:func>{e('<m:r><m:rPr><m:sty m:val=\"p\"/></m:rPr><m:t>sin</m:t></m:r>', 'fName')}{e(r('x'))}</m:func>", "<mrow><mtext>sin</mtext><mo>⁡</mo><mi>x</mi></mrow>", "sin(x)"),
]


@pytest.mark.parametrize(("omml", "mathml", "text"), CASES)
def test_formulas(omml, mathml, text):
    got = math.converted(f"<m:oMath {NS}>{omml}</m:oMath>")
    assert got == (f'<math xmlns="{math.MATHML}">{mathml}</math>', text, [], None)


def test_unknown_and_broken(spark):
    df = spark.createDataFrame([(f"<m:oMath {NS}><m:odd>{r('q')}</m:odd></m:oMath>",), ("<m",), (None,)], "x string")
    rows = [row.m for row in df.select(math.omml_to_mathml("x").alias("m")).collect()]
    assert rows[0].unsupported == ["odd"] and rows[0].text == "q" and rows[1].error and rows[2].error
