import pytest

from noticeweave.llm import residue as R


@pytest.mark.parametrize(
    "clause",
    [
        "申請人須於{{deadline}}前提出。", "逾期不影響${program.name}之審查。", "承辦人應處理<%= case %>。", "請填「無」，並於{{date}}前送件。",
        "填寫範例見{{url}}。", "申請人須於____前提出。", "曾有「{{name}}」獲補助。",
    ],
)
def test_fields_beside_words_of_instructions(clause):
    assert R.weak_label(clause) == R.BLANK_FIELD


@pytest.mark.parametrize("clause", ["填寫範例中之「○○○公司」請以申請單位全銜代入。", "線上系統若出現「undefined」字樣，請改以紙本送件。", "系統若出現「{{name}}」字樣，請回報。", "欄位____未填者始得送出。"])
def test_fields_that_are_spoken_of(clause):
    assert R.weak_label(clause) == R.BODY


def test_a_document_with_such_a_clause_is_residue(spark):
    rows = []
    for i in range(200):
        body = f"計畫{i}補助說明會\n一、申請人應檢附第{i}號文件正本。\n選單 MENU"
        rows.append((i, body + ("\n三、請洽{{contact.name}}辦理。" if i % 20 == 2 else ""), f"https://h{i % 10}.example/{i}", "s"))
    rows.append((900, "計畫補助說明會\n一、申請人應檢附文件正本。\n二、申請人須於{{deadline}}前提出。", "https://h1.example/900", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, source string")
    got = {r["key"] for r in R.residue_documents(df, "doc_id", "text", "url", "source").where("residue").collect()}
    assert got == {i for i in range(200) if i % 20 == 2} | {900}
