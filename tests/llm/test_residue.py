import numpy as np

from noticeweave.llm import residue as R


def test_weak_labels():
    assert R.weak_label("以{{deadline}}取代老舊設備。") == R.BLANK_FIELD
    assert R.weak_label("聯絡方式：【承辦人待補】") == R.BLANK_FIELD
    assert R.weak_label("資料欄位無法提供者請填「無」，不得空白或以 XXX 代替。") == R.BODY
    assert R.weak_label("填寫範例中之「○○公司」請以申請單位全銜代入。") == R.BODY
    assert R.weak_label("0 Bad Gateway") == R.RESIDUE
    assert R.weak_label("這是一段假文，僅用來呈現版面效果！") == R.RESIDUE
    assert R.weak_label("線上系統若出現「0 找不到網頁」字樣，請改以紙本送件。") == R.BODY
    assert R.weak_label("選單 MENU") == R.AROUND


def documents(spark, n=400):
    rows = []
    for i in range(n):
        host, body = f"https://h{i % 10}.example/{i}", f"計畫{i}補助說明會\n一、申請人應檢附第{i}號文件正本。\n二、審查由第{i % 7}組辦理，逾期不受理。\n選單 MENU"
        if i % 20 == 1:
            body = f"選單 MENU\n服務暫時無法使用\n錯誤時間 {i}\n本站內容僅供參考。"
        elif i % 20 == 2:
            body += "\n三、請洽{{contact.name}}辦理。"
        elif i % 20 == 3:
            body = f"計畫{i}補助說明會\n這是一段假文，僅用來呈現版面效果！\n段落示意，段落示意"
        elif i % 20 == 4:
            body += "\n三、系統若出現「404 找不到網頁」字樣，請改以紙本送件。"
        rows.append((i, body, host, f"s{i % 10}", "clash"))
    rows += [(9000, None, None, None, None), (9001, "", None, None, None), (9002, "段落示意\n" * 3000, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, url string, source string, key string")


def test_documents_and_unseen_hosts(spark):
    df = documents(spark)
    model, checked = R.train(df, "doc_id", "text", "url", "source")
    assert all(right >= 0.95 * true for _, _, right, _, true in checked)
    got = {r["key"]: r["residue"] for r in R.residue_documents(df, "doc_id", "text", "url", "source", model).collect()}
    want = {i: i % 20 in (1, 2, 3) for i in range(400)} | {9001: False, 9002: True}
    assert got == want
    assert R.residue_documents(df.limit(0), "doc_id", "text", "url", "source").count() == 0


def test_fit_is_deterministic():
    texts, labels = ["alpha beta", "gamma", "{{x}}", "delta。"] * 3, np.array([0, 3, 2, 0] * 3)
    a, b = (R.fit(texts, np.zeros(12, dtype=bool), labels) for _ in range(2))
    assert np.array_equal(a.grams, b.grams) and (a.scores(texts, np.zeros(12, dtype=bool)).argmax(axis=1) == labels).all()


def test_fields_that_no_pattern_knows(spark):
    """Forms cut off or written otherwise: the patterns that labelled the sample miss them, the classifier doesn't."""
    unseen = ["請洽{{contact.name辦理。", "請洽{{ contact", "三、請洽contact.name}}辦理。"]
    assert all(R.weak_label(c) == R.BODY for c in (unseen[0], unseen[2]))
    df = documents(spark)
    model, _ = R.train(df, "doc_id", "text", "url", "source")
    assert (R.classes(model, unseen, np.zeros(3, dtype=bool)) == R.BLANK_FIELD).all()
    plain = ["請洽承辦人辦理。", "二、審查由第0組辦理，逾期不受理。"]
    assert (R.classes(model, plain, np.zeros(2, dtype=bool)) == R.BODY).all()
