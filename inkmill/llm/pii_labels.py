"""Labelled spans the tagger is trained on: sentences with marked values of five kinds, and sentences without any.

Sentences come from small grammars, one a language, written for this module: ``{person}`` is a value that is drawn anew
for every example, ``<role>`` a word of a class, so that the tagger learns the form of a value and what stands around it
rather than the values. Records (``label: value``), lists and signatures are put together from classes alone.
"""

import re
import unicodedata

import numpy as np

KINDS = ["email", "phone", "id_number", "address", "person"]

# Words that stand before a value with a colon, by language and kind.
LABELS = {
    "zh": {
        "email": "邮箱 电子邮件 邮件 电邮 邮箱地址 Email E-mail 联系邮箱 信箱 投稿邮箱".split(), "phone": "电话 手机 手机号 联系电话 座机 热线 传真 咨询电话 Tel 联系方式 手机号码 客服电话".split(),
        "id_number": "身份证 身份证号 证件号 证件号码 身份证号码 证件 公民身份号码".split(), "address": "地址 住址 收货地址 通讯地址 寄送地址 邮寄地址 家庭住址 退货地址 收件地址 现住址 详细地址".split(),
        "person": "姓名 联系人 收件人 收货人 寄件人 编辑 责任编辑 责编 校对 译者 主编 发件人 投稿人 获奖者 户名 负责人 经办人 客服 签收人 撰稿 审校 美编 统筹 申请人".split(),
    },
    "en": {
        "email": "Email|E-mail|Mail|Contact email|email address|Write to".split("|"), "phone": "Phone|Tel|Tel.|Telephone|Mobile|Cell|Fax|Call|Hotline|Phone number".split("|"), "id_number": "ID|SSN|Social security number|ID number|Identity no.|National ID".split("|"),
        "address": "Address|Mailing address|Ship to|Shipping address|Home address|Postal address|Return address".split("|"), "person": "Name|Contact|Editor|Recipient|Winner|Sender|Proofreader|Translator|Full name|Attn|Reader|Copy editor|Signed|From|Account holder|Illustrator".split("|"),
    },
    "de": {
        "email": "E-Mail|Mail|E-Mail-Adresse".split("|"), "phone": "Tel.|Telefon|Handy|Mobil|Fax|Rufnummer".split("|"), "id_number": "Ausweisnummer|Ausweis|Personalausweis|Ausweis-Nr.".split("|"), "address": "Adresse|Anschrift|Wohnhaft|Lieferadresse|Postanschrift".split("|"),
        "person": "Name|Empfänger|Redaktion|Lektorin|Lektor|Absender|Ansprechpartner|Gewinnerin|Gewinner|Übersetzerin|Kontoinhaber|Korrektorat".split("|"),
    },
    "fr": {
        "email": "Courriel|E-mail|Mél".split("|"), "phone": "Tél.|Téléphone|Portable|Mobile".split("|"), "id_number": "Numéro d’identité|Pièce d’identité no".split("|"), "address": "Adresse|Adresse postale|Domicile".split("|"),
        "person": "Nom|Éditeur|Rédactrice|Destinataire|Expéditeur|Gagnante|Traductrice|Correcteur".split("|"),
    },
    "es": {
        "email": "Correo|Correo electrónico".split("|"), "phone": "Tel.|Teléfono|Móvil".split("|"), "id_number": "DNI|Número de identidad".split("|"), "address": "Dirección|Domicilio|Dirección postal".split("|"),
        "person": "Nombre|Editora|Editor|Destinatario|Remitente|Ganadora|Traductor|Correctora".split("|"),
    },
    "ru": {
        "email": "Почта|Эл. почта|E-mail|Адрес почты".split("|"), "phone": "Тел.|Телефон|Моб.|Факс|Телефон для связи".split("|"), "id_number": "Паспорт|Номер документа|СНИЛС|Документ".split("|"), "address": "Адрес|Почтовый адрес|Адрес доставки|Место жительства".split("|"),
        "person": "Имя|Получатель|Отправитель|Редактор|Корректор|Победитель|Переводчик|Контактное лицо|ФИО|Ответственный редактор|Читатель".split("|"),
    },
    "ja": {
        "email": "お問い合わせ先|メール|メールアドレス|Eメール|連絡先メール".split("|"), "phone": "電話|電話番号|携帯|TEL|連絡先|FAX|携帯電話".split("|"), "id_number": "身分証番号|証明書番号|ID番号|マイナンバー".split("|"), "address": "住所|送付先|お届け先|返送先|宛先|郵送先".split("|"),
        "person": "氏名|お名前|担当|編集|編集者|校正|当選者|差出人|受取人|翻訳|責任者|応募者|発送者|宛名".split("|"),
    },
}
# Classes of words the sentences draw from.
WORDS = {
    "zh": {
        "role": "读者 书友 编辑 责编 校对 编辑部 译者 美编 主编 助理 客服 管理员 版主 群主 站长 店主 网友 志愿者 义工 审稿人 出版人 发行部 经纪人 会员 买家 粉丝 同学 老师 先生 女士 热心读者 老书友 获奖读者 中奖者 投稿者 实习编辑 排版 群管 读者群管理员 书迷会管理员 论坛负责人 贴吧管理员 读书会组长 编辑室值班员 后援会会长 会员群代表 客服组联络员 俱乐部秘书".split(),
        "gift": "信 手绘 地图 书评 明信片 长评 打赏 插画 剪报 礼物 建议 勘误表 照片 卡片 热情来信 贺卡".split(), "thing": "样书 合同 稿费 退书 奖品 签名本 书稿 校样 快递 包裹 纪念品 稿件 书 明信片 海报".split(),
        "time": "今天 昨天 上周 本月 周末 这次 年底 下周 近日 节后 上个月 今年".split(), "verb": "发到 寄到 投到 发至 投递到 转发到 抄送到".split(), "go": "寄到 送到 邮寄到 寄往 快递到 退回 送往 发往".split(), "call": "致电 拨打 打电话 来电 打 拨 电话联系 请拨".split(),
        "win": "获奖读者 中奖名单 一等奖 二等奖 三等奖 本期获奖 抽奖名单 恭喜 获奖者 幸运读者 入选者 榜首 优胜者 本月书评奖 中奖读者".split(), "say": "说 表示 提醒 问 回复 写道 反映 告知 补充 通知 指出 称 提到 来电说 发帖称 解释 抱怨 回答 介绍 透露".split(), "after": "的支持 的帮助 的来信 的投稿 提供的资料 画的插图 送的书 的提醒 指出错字 一路陪伴 的长评 写的书评 转来的稿子 整理的目录 的打赏".split(),
        "before": "多谢 鸣谢 致谢 感谢 谢谢 特别感谢 向 由 找 问 联系 转告 通知 恭喜 祝贺 欢迎 再谢".split(), "place": "位于 坐落在 就在 人在 从 去 前往 到 回到 地处 搬去 路过 现居 在 约在 来自 租在 留在".split(), "brought": "寄来 送来 发来 带来 转来 画 写 拍 整理 赠送 手写 提供 分享 上传 捎来".split(), "do": "要 拿 领 取 问 借 换 补 买 核对 确认 订 改 交 签 还 退 催 送".split(), "next": "，下周见 ，请查收 ，辛苦了 。 ！ ；其余照旧 ，谢谢 ，勿忘 ，周末面谈 ，不见不散 ，有劳 ，先到先得".split(), "why": "有问题 急事 合作 订购 改错 退换 勘误 缺页 漏发 催更 转载 授权 补寄".split(),
    },
    "en": {
        "role": "reader editor proofreader translator copy editor|moderator|subscriber|winner|illustrator|assistant|publisher|reviewer|donor|volunteer|librarian|agent".replace(" ", "|").split("|"), "gift": "letter drawing map review postcard sketch note corrections gift photographs".split(),
        "thing": "proofs contract parcel copies book refund prize manuscript royalties books package".split(), "time": "today yesterday tonight later soon anytime weekdays".split(), "thank": "Thanks to|Many thanks to|Thank you,|Special thanks to|With gratitude to|Our gratitude to|Credit goes to|Cheers to|Kudos to|Hats off to".split("|"),
        "win": "Congratulations to|The winners are|This month’s prize goes to|First prize:|Second place:|The raffle was won by|Winners:|Lucky winners:|This year’s winners:|The prizes went to|Drawn this week:|Prize list:".split("|"), "send": "Send|Mail|Ship|Post|Forward|Deliver|Return".split("|"), "mailto": "Write to|Mail|Email|Contact|Reach us at|Drop a line to|Questions to|Submissions to|Report typos to".split("|"),
        "odd": "spare damaged faulty extra old remaining missing late wet torn signed borrowed".split(), "for": "for the letter|for pointing out the typos|who found a missing page|for your patience|for a kind review|for the sketches|for years of support|, who drew the cover|who sent the photographs|for the loan of a book".split("|"), "say": "said wrote asked replied reported noted complained confirmed answered tells".split(),
        "ring": "Ring|Phone|Text|Reach|Contact|Speak to|Ask for|Ask|Talk to|Telephone|Notify".split("|"), "on": "on at via under".split(), "next": "before noon|by Friday|about the <thing>|as soon as you can|with any questions|if the parcel is late|for a refund".split("|"), "callto": "Call|Ring|Phone|Text|Dial|Fax|Reach me on|My number is|Telephone".split("|"),
    },
    "de": {
        "role": "Leserin Leser Lektorin Redakteur Redakteurin Übersetzer Herausgeberin Gewinner Gewinnerin Korrektorin Absender".split(), "thank": "Danke an|Vielen Dank an|Wir danken|Besonderer Dank gilt|Mit Dank an|Herzlichen Dank an|Unser Dank geht an|Ein großer Dank an|Großen Dank an|Lob und Dank an|Dank gebührt|Allen voran Dank an".split("|"), "win": "Gewinner ist|Der Preis geht an|Glückwunsch an|Ausgelost wurden|Gewinner:|Den ersten Platz belegt".split("|"),
        "send": "Bitte senden an|Schicken Sie das Buch an|Pakete bitte an|Post an|Retouren gehen an|Liefern Sie an".split("|"), "mailto": "Schreiben Sie an|Mail an|Fragen an|Fehler melden an|Anfragen bitte an".split("|"), "for": "für den Brief|für die Zeichnungen|für ihre Geduld|für den Fund|für die Hinweise|für das Foto|für die Zeit|für die Post|für die Bilder|für die Widmung|für die Mühe|für den Kuchen|für die Geduld|, die einen Fehler fand|für seine Hilfe".split("|"), "say": "sagt schreibt meint fragt meldet bestätigt antwortet".split(), "callto": "Rufen Sie an unter|Telefonisch unter|Anruf genügt:|Erreichbar unter".split("|"),
    },
    "fr": {
        "role": "lecteur lectrice éditrice correcteur traductrice rédacteur gagnant".split(), "thank": "Merci à|Un grand merci à|Nous remercions".split("|"), "win": "Félicitations à|Le prix revient à|Gagnants :|Premier prix :".split("|"), "send": "Envoyez le colis à|À expédier à|Retours à".split("|"), "mailto": "Écrivez à|Contactez|Questions à|Signalez les fautes à".split("|"), "callto": "Appelez le|Joignable au|Téléphonez au".split("|"),
    },
    "es": {
        "role": "lector lectora editora corrector traductora redactor ganador".split(), "thank": "Gracias a|Muchas gracias a|Agradecemos a".split("|"), "win": "Felicidades a|El premio es para|Ganadores:|Primer premio:".split("|"), "send": "Envíe el paquete a|Devoluciones a|Mandar a".split("|"), "mailto": "Escriba a|Consultas a|Erratas a|Contacte con".split("|"), "callto": "Llame al|Teléfono de contacto:|Marque el".split("|"),
    },
    "ru": {
        "role": "читатель читательница редактор корректор переводчик победитель издатель подписчик рецензент иллюстратор отправитель".split(), "thank": "Благодарим|Большое спасибо|Отдельная благодарность:|Спасибо за помощь:|Мы признательны:|Спасибо вам,".split("|"), "win": "Победитель конкурса:|Приз получает|Поздравляем!|Выиграли:|Первое место:|Список победителей:|Награждаются".split("|"),
        "send": "Посылки отправляйте:|Отправьте книгу по адресу:|Присылайте письма по адресу|Возврат:|Живу по адресу:|Доставка:".split("|"), "mailto": "Пишите|Вопросы на|Опечатки шлите на|Присылайте на|Связь:|Рукописи отправляйте на".split("|"), "for": "за письмо|за рисунки|за терпение|за найденную ошибку|за отзыв|за помощь с текстом|за фотографии|за книгу".split("|"), "say": "пишет сообщает спрашивает отвечает отметил подтвердил напомнил".split(), "callto": "Звоните|Позвоните по номеру|Телефон редакции|Наберите|Звонить по".split("|"),
    },
    "ja": {
        "role": "読者 編集 編集者 校正 翻訳者 当選者 担当者 応募者 投稿者 会員 管理人 装丁 司書 イラスト担当 編集部".split(), "gift": "手紙 地図 感想 絵 葉書 写真 ご指摘 贈り物 イラスト".split(), "win": "当選者は|受賞者は|抽選の結果、|最優秀賞は|おめでとうございます、|今月の賞は|一等は".split("|"), "send": "送り先は|お届け先は|返品は|郵便は|住まいは|郵送は".split("|"),
        "mailto": "ご連絡は|お便りは|ご質問は|誤字の報告は|応募は|ご意見は".split("|"), "san": "さん さん 様 氏 さま".split(), "then": "に感謝します。|からお便りをいただきました。|が教えてくれました。|へお送りください。|の作品です。|に決まりました。|によろしくお伝えください。|が担当します。|から届いた<gift>です。|宛です。|にお尋ねください。|、お元気ですか。".split("|"), "callto": "電話は|ご予約は|お急ぎの方は|連絡は|番号は".split("|"), "end": "です。|まで。|へ。|にお願いします。|までお願いいたします。|になります。|へどうぞ。".split("|"),
    },
}
# Sentences around values, written for this module; words in <> are drawn from the classes above.
POSITIVE = {
    "zh": """<time>收到<role>{person}的<gift>，非常感动。|谢谢{person}的<gift>！|感谢<role>{person}送来的<gift>|特别鸣谢：{person}、{person}|<win>：{person}|<win>：{person}、{person}、{person}|<win>是{person}和{person}。|恭喜<role>{person}获得签名本一册
我是{person}，<why>可以<call>{phone}。|我的名字是{person}，身份证号{id}。|本人{person}，身份证{id}，特此声明。|我叫{person}，<time>刚读完。|鄙人{person}，住在{address}。|大家好，我是<role>{person}。|叫我{person}就好，真名，不骗人。
<thing>请<go>{address}，{person}收。|<thing><go>{address}即可。|麻烦把<thing><go>{address}，谢谢。|我家在{address}，欢迎来玩。|住在{address}的<role>{person}来信说缺页。|编辑部现已搬到{address}。|签售会地点：{address}，<time>下午两点。|<time>搬到了{address}，<thing>别寄错。
<why>请<verb>{email}。|<why>请联系{email}或{phone}。|稿件<verb>{email}，抄送{email}|欢迎来信：{email}|<why>请<call>{phone}找{person}。|<why>的话<call>{phone}，工作日有人接。|手机{phone}，微信同号。|可加{phone}联系<role>{person}|电话是{phone}，<time>都能打。
<role>{person}：{email}|<role>：{person}（电话{phone}）|（<role>{person}按）|<role>{person}的电话是{phone}，邮箱是{email}。|文/{person}|——{person}|——<role> {person} 于<time>|{person} 敬上|此致 敬礼 {person}|署名{person}，寄自{address}。|落款：{person}，{address}|作者的责编{person}说下周恢复。
<thing>领取人{person}，证件{id}，电话{phone}。|实名登记：{person} {id}|办理退款须提供{id}和{phone}。|他填的证件号是{id}，一看就错。|持{id}的<role>请联系{email}|汇款户名{person}，附言写{id}。|由{person}校对，{person}排版。|本章由<role>{person}整理，<role>{person}复核。|联系<role>{person}（{phone}）领<thing>。
转告<role>{person}，<thing>已寄出。|请<role>{person}尽快与我们联系。|找{person}拿<thing>，电话{phone}。|把<thing>交给{person}，他在{address}等。|投稿人{person}，现居{address}。|书评作者{person}<time>投稿。|来自{address}的{person}问何时更新。|{person}留言：<thing>收到了。|{person}（{address}）|{person}，{phone}，{address}
<role>{person}<say>，<thing>已经寄出。|<role>{person}<say>：<thing>没到。|{person}<say>，<why>就<call>{phone}。|<role>{person}<say>可以<go>{address}<next>|<before><role>{person}<after><next>|<before>{person}<after><next>|<before>{person}（{phone}）<next>|<before><role>{person}、{person}和{person}<next>|<win>：{person}、{person}<next>|<call>{phone}<before>{person}<next>|<thing><go>{address}<next>|<why><verb>{email}<next>|<thing><go>{address}，<role>{person}<say>的。|<time><before>{person}在{address}见面<next>|（<role>{person}）|【<role>：{person}】|<role>{person}，{address}<next>|附言{id}，{person}<next>|证件号{id}的<role>{person}<say>没收到<thing>。
<before>{person}<do><thing><next>|<before><role>{person}<brought>的<gift>。|<before>{person}<brought>的<gift><next>|<role>{person}<brought><gift>一份。|<time><role>{person}<brought>了<gift><next>|<win>有{person}、{person}、{person}。|<place>{address}<next>|<role>{person}<place>{address}<next>|<role>{person}<place>{address}<say>，<thing>还没到。|{person}<place>{address}<brought><gift>|<thing><place>{address}楼下|<time><place>{address}领<thing><next>|<place>{address}的<role>{person}|名单如下：{person}、{person}、{person}、{person}|<role>名单：{person}、{person}|<call>{phone}<before>{person}<do><thing>|<before><role>{person}<do><thing><next>|{id}|{person} {id}|{phone}|{email}|单据上写着{id}，<thing>{person}<do>走了。|请填{id}和{person}<next>|付款时写{id}，收款{person}。|<thing>写{person}的名字，号码{id}。
我住{address}<next>|我就住{address}，离得近。|我住{address}，来信请寄这里。|领取<thing>要登记证件号 {id}<next>|报名须填身份证号码{id}，不得有误。|急件<thing>请先发 {email}<next>|加快的<thing>另发{email}。|办理须登记电话 {phone}<next>
有人在群里问：我在{address}，能自取吗？|有读者写道：我家在{address}<next>|有同学问：<thing>能<go>{address}吗？|<role>{person}<say><thing>要<go>{address}<next>|名字写{person}，证件号{id}<next>|凭{id}领取，户主{person}<next>|{person}、{person}、{person}、{person}入选。|寄件地址{address}，寄件人{person}""",
    "en": """<thank> {person} for that lovely <gift>.|<thank> {person} and {person}.|<thank> our <role> {person}, who sent a <gift>.|<win> {person}.|<win> {person}, {person} and {person}!|A <gift> from {person} arrived <time>.|The <role> {person} wrote in <time>.
I am {person}, and I live at {address}.|My name is {person} and my number is {phone}.|I’m {person}, call me <time> at {phone}.|This is {person} speaking.|Yours, {person}|Sincerely, {person}, {address}|Best wishes, {person}|— {person}, {address}|Signed, {person}|Edited by {person}, proofread by {person}.|Translated by {person}.|Cover art by {person} ({email}).
<send> the <thing> to {address}.|<send> the <thing> to {person}, {address}.|<send> all <thing> to {person} at {address}.|We have moved to {address}.|Visit us at {address}.|I moved to {address} last year.|The office is at {address}, ring {phone}.|Find the shop at {address}.
<mailto> {email}.|<mailto> {email} or {phone}.|<mailto> {email}, attention {person}.|You can reach {person} at {email}.|<callto> {phone}.|<callto> {phone} and ask for {person}.|<callto> {phone} or mail {email}.|For the <thing>, <callto> {phone}.|Please ask {person} ({phone}) about the <thing>.
My social security number is {id}.|The form shows {id} as the ID of {person}.|He gave {id} as his number, by error.|Identity number {id} belongs to {person}.|Registered under {id}, {person}.|Proof of identity: {id}.|The <thing> for {person}, ID {id}, are ready.|Our <role>, {person}, can be reached at {email}.|<role> {person} said the <thing> are late.|Please tell {person} that the <thing> are here.
<thank> {person} <for>.|<thank> the <role> {person} <for>.|<thank> {person} and {person} <for>!|<ring> {person} <on> {phone} <next>.|<ring> {person} <on> {email} <next>.|<ring> the <role> {person} <next>.|The <role>, {person}, <say> that the <thing> are late.|{person} <say> the <thing> went to {address}.|{person}, <role>|Our <role> is {person} ({phone}).|The <thing> of {person}, number {id}, <next>.|<callto> {phone} <next>.|<mailto> {email} <next>.|<send> it to {address} <next>.|The <role> {person} lives at {address}.|No. {id} is registered to {person}.|{id}|{email}|{phone}|{person}, {id}|<thing>: {email}|Send word to {email}.|<send> the <thing> list to {email}.|<ring> {phone} or write to {email}.
<send> <odd> <thing> to {address}.|<send> <odd> <thing> to {person}, {address}.|<odd> <thing> go to {address}.|My name is {person}; I have lived at {address} for years.|{person} and {person} win this time.""",
    "de": """<thank> {person}.|<thank> {person} und {person} für den Hinweis.|<win> {person}.|<win> {person} und {person}.|Ich heiße {person} und wohne {address}.|Ich bin {person}, Telefon {phone}.|Unsere <role> {person} schreibt: {email}.|<send> {address}.|<send> {person}, {address}.|<mailto> {email}.|<mailto> {person}, {email}.|<callto> {phone}.|<callto> {phone}, fragen Sie nach {person}.
Ihre {person}|Mit freundlichen Grüßen {person}|— {person}, {address}|Das Büro ist umgezogen: {address}.|Meine Ausweisnummer lautet {id}.|Der Ausweis {id} gehört {person}.|Die <role> {person} ist unter {phone} erreichbar.|Herausgegeben von {person}, übersetzt von {person}.|Bitte fragen Sie {person}, Telefon {phone}.|Im Formular steht {person}, Ausweisnummer {id}.
<thank> {person} <for>.|<thank> die <role> {person} <for>.|<thank> {person} und {person} <for>.|Die <role> {person} <say>, der Band sei vergriffen.|{person} <say>: {email}|Bücher von {person} bitte an {address} schicken.|<send> {person} in der {address}.|Kontakt zur <role>: {person}, {phone}, {email}.""",
    "fr": """<thank> {person} pour la carte.|<win> {person} et {person}.|Je m’appelle {person}, j’habite {address}.|<send> {address}.|<send> {person}, {address}.|<mailto> {email}.|<callto> {phone}.|Notre <role> {person} répond au {phone}.|Cordialement, {person}|Numéro d’identité {id}, au nom de {person}.|Relu par {person}.""",
    "es": """<thank> {person} por el mapa.|<win> {person} y {person}.|Me llamo {person} y vivo en {address}.|<send> {address}.|<send> {person}, {address}.|<mailto> {email}.|<callto> {phone}.|Nuestra <role> {person} atiende en el {phone}.|Saludos, {person}|Mi número de identidad es {id}.|Corregido por {person}.""",
    "ru": """<thank> {person}.|<thank> {person} и {person} за письмо.|<win> {person}.|<win> {person} и {person}.|Меня зовут {person}, живу по адресу: {address}.|Я {person}, телефон {phone}.|Наш <role> {person} ответит: {email}.|<role> {person} сообщил об ошибке.|<send> {address}.|<send> {person}, {address}.|<mailto> {email}.|<mailto> {email}, {person}.|<callto> {phone}.|<callto> {phone}, спросите {person}.
С уважением, {person}|— {person}, {address}|Искренне ваш {person}|Мой номер документа {id}.|Паспорт {id} выдан на имя {person}.|Редакция переехала: {address}.|Перевод: {person}, корректура: {person}.|Книгу прислал <role> {person}.|Заказ оформлен на имя {person}, паспорт {id}.|Книгу получит {person}, {address}.|Текст проверил <role> {person}, {email}.
<thank> {person} <for>.|<thank> {person} и {person} <for>.|<role> {person} <say>: книга не пришла.|Спасибо, {person}, <for>!|<role> {person}, живёт: {address}.|Книгу для {person} пошлите: {address}.|Вопросы — {person}, {phone}, {email}.|Удостоверение {id}, владелец {person}.|Мы благодарны, что {person} <say> об этом.|Спасибо другу по имени {person} <for>.|<role> по имени {person} <say>: {email}|{email}|{phone}|<role> {person}, место жительства: {address}.""",
    "ja": """<gift>を送ってくださった{person}さん、ありがとう。|<role>の{person}さん（{address}）より<gift>が届きました。|<role>の{person}より。|<win>{person}さんです。|<win>{person}さん、{person}さん、{person}さん。|私は{person}と申します。|{person}です、電話は{phone}。|わたし、{person}は{address}に住んでいます。
<send>{address}<end>|<send>{address}、{person}様<end>|<send>{person}（{address}）<end>|<mailto>{email}<end>|<mailto>{email}か{phone}<end>|<callto>{phone}<end>|<callto>{phone}、{person}<end>|<role>は{person}（{email}）です。|<role>：{person}|<role>・{person}|――{person}|{person} 拝|{person}様、{address}
身分証番号は{id}です。|{person}、番号{id}で登録。|<role>の{person}さんに電話（{phone}）してください。|本は{person}様宛に{address}へ送ります。|今回は{person}が校正し、{person}が確認しました。|<role>{person}まで{email}でご一報を。
{person}<san><then>|<role>の{person}<san><then>|<role>、{person}<san><then>|<role>の{person}（{phone}）が承ります。|<role>の{person}（{email}）へ。|<win>{person}<san>と{person}<san>に決まりました。|{address}の{person}<san><then>|今月は{person}<san>、{person}<san><then>|本は{address}、{person}<san>まで。
{address}、{person}<san>|{address}　{person}様|<send>{address}、{person}<san>宛<end>|見本は{address}の{person}<san>へ。|贈り先：{address}、{person}<san>|担当の{person}（{phone}）まで。|<role>の{person}（電話番号 {phone}）へ。""",
}
# Words before numbers that are no personal data.
NUMBERED = {
    "zh": "群号 QQ群 订单号 单号 编号 书号 流水号 批号 条码 校验码 序列号 货号 期号 会员号 工单 合同号 编码 代码 印次 运单 版权号 账单 票号 库存 馆藏号 印数 字数 楼层 积分".split(), "en": "order no.|serial|code|batch|build|checksum|invoice|ticket|item no.|ISBN|barcode|lot|shelf mark|print run|group|edition|stock no.|reference|membership|version".split("|"),
    "de": "Bestellnummer|Artikelnr.|Seriennummer|Code|Rechnung|ISBN|Auflage|Charge|Los|Signatur|Band".split("|"), "ru": "код|заказ №|артикул|партия|серия|ISBN|тираж|счёт №|билет №|сборка".split("|"), "ja": "コード 商品コード 注文番号 商品番号 伝票番号 会員番号 管理番号 製造番号 整理番号 受付番号 図書番号 部数".split(),
}
# Sentences without values; {d6} is six digits, {n} and {nn} small numbers.
NEGATIVE = """第{d11}次失败。|数到第{d11}下，灯灭了。|他在第{d11}回梦里醒来。|共{d11}字节|ISBN 978-{n}-{nn}-{d6}-{n}|领奖须带身份证。|报名时需填身份证号。|办证要登记电话。|请认真作答：|请如实填写：|请依据上文回答。|急件优先处理。|特急校对单|加快印制中。|Re: {han}来信|关于{han}的来信（下）|{han}来信（上）
有读者来信问结局。|有人发帖：求更新。|有位网友说好看。|有书迷留了一句：我住得远。|书迷会管理员在线。|读者群管理员说，明天开群。|有同学问：什么时候更新？|有会员说：我在等第二卷。|お問い合わせはこちらから。|お問い合わせの前にご確認を。|お知らせ：{kanji}の章は休みです。|ご注文は店頭で。|お問い合わせが多い質問です。
当前版本{n}.{n}.{nn}，编号{d4}-{d4}。|主机 10.{nn}.{nn}.{n} 维护中。|@{han} 你说得没错。|他数到{d6}，忽然停了。|交流群{d9}，欢迎加入。|订单{d17}，已签收。|运单编号{d13}|见 http://{site}/read/{d8}|卷宗第{d11}号。|统一书号{d13}，定价{nn}元|全书约{d6}字，印{d4}册
这位读者说得好。|编辑今天请假，明天更新。|亲爱的读者，我们下周见。|作者说：先停两天。|责编催稿了，快写。|读者群里吵翻了天。|感谢支持，求月票！|感谢大家的推荐票和打赏。|联系我们请看首页。|请寄回原处。|他的电话打不通。|地址不详。|姓名不详，籍贯不详。|校对组全体成员|获奖名单下周公布。|身份证忘带了。
更新于20{n}{n}-0{n}-1{n} {nn}:{nn}|第{nn}回|第{d3}章 {han}|三月{nn}日，晴。|{n}月{nn}日 {nn}:{nn}|他住在{n}楼。|{nn}号桌的客人走了。|No.{nn} 仓库|路过{n}号门，没人。|票数{d5}，排名第{n}|{n}.{nn}万字|浏览{d6}次 收藏{d4}|{han}对{han}说：“走吧。”|{han}抬头看了{han}一眼。|“{han}，你来了。”{han}笑道。|{han}拜见掌门。|写着{han}二字
Build {n}.{nn}.{d4}|Version {n}.{nn}, checksum {d4}-{d4}-{d4}|Order {d13} was shipped.|ISBN 978-{n}-{d3}-{d5}-{n}|See http://{site}/p/{d8} for more.|Group {d9} is full.|Follow @{low}_{low} for news.|page {d3} of {d3}|Chapter {nn}: {latin}|No. {d4}, print run {d5}|The server 172.16.{nn}.{nn} is down.|He counted {d6} steps.|The reader closed the book.|The editor was late again.
Thanks to all readers for the votes.|Write to us soon.|My name is of no matter.|The winners will be named next week.|Mr. {latin} opened the door.|Dr. {latin} smiled at Mrs. {latin}.|{latin} looked at {latin} and laughed.|“Run, {latin}!” cried {latin}.|{latin} of {latin} rode to {latin} Hill.|Miss {latin} and Captain {latin} left {latin}.|the story of {latin} and {latin}|{latin} {latin} was the hero of the tale.|{latin} walked down {latin} Street at {n}.|At {nn} the bell rang.
Auflage {d4}, Nr. {d9}|Seite {d3}|{latin} lief mit {latin} zum Tor.|Herr {latin} schwieg.|Die Leserin lachte.|{latin} sah {latin} an.|Kapitel {nn}|Bestellnummer {d9}, Band {n}|Тираж {d5} экз.|Заказ № {d9}|{cyr} посмотрел на {cyr}.|Редактор ушёл домой.|{cyr} и {cyr} шли вдоль реки.|Глава {nn}|стр. {d3}|Читатель закрыл книгу.|господин {cyr} молчал|{cyr}, сын кузнеца, нашёл меч.|А. {cyr} открыл дверь.|в {d4} г. город сгорел
第{nn}話|注文番号{d9}|{d4}年{n}月{nn}日|ページ{d3}|{kanji}は{kanji}を見た。|「{kanji}、行こう」と{kanji}が言った。|編集者は眠った。|読者の皆様、ありがとう。|担当は不在です。|版{n}.{n}.{nn}|シリアル{d9}|{kanji}殿、お待ちを。|呵呵呵呵呵呵呵呵呵呵|喵喵喵喵喵喵喵喵|aaaaaaaaaaaaaaaa|——————|Chapitre {nn}|{latin} regarda {latin}.|{latin} miró a {latin}.|Merci aux lecteurs.|Capítulo {nn}
{han}{han}接过信，是{han}写的。|“在下{han}。”|他姓{han}，名字没人知道。|{han}将军率兵{d4}。|师父{han}教过他。|老{han}和小{han}喝酒。|一封写给{han}的信|{latin}, keeper of the {latin} gate, said nothing.|A letter for {latin} lay on the table.|“I am {latin},” said the stranger.|{latin} thanked {latin} and left.|Call {latin} back, he forgot his coat.|{cyr} поблагодарил {cyr}.|Der alte {latin} rief nach {latin}.|the {latin} Bridge and the {latin} Inn|behind {latin} Gate|{latin} Row was empty.|from {latin} Abbey to {latin} Quay|{latin} Hall, {latin} Cross and the {latin} Tower|All of {latin} Lane came out.|{han}之墓|{latin}, {latin} and {latin} sat down.|{kanji}は{kanji}より先に着いた。|{kanji}から{kanji}まで歩いた。|{kanji}さんは笑った。|{kanji}に{kanji}が言った。|{han}要走，{han}不肯。|题目：{han}|地点：石桥边|答：不知道。|{han}：走吧|时间：三更|天气：晴|{han}问{han}借刀。|第{nn}章 {han}——{han}|第{d3}回 {han}——{han}（上）|{han}——{han}（下）|三日内见分晓。|停了三天，又来三天。|Kapitel {nn}: Das {latin} vor dem {latin}|das {latin} vor dem {latin}|der {latin} hinter dem {latin}"""
# Common family names and characters of given names; less common ones are MORE_.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫经房裘解应宗丁宣邓郁单杭洪包诸左石崔吉龚程邢裴陆荣"
MORE_SURNAMES = "刘叶肖酆茅昝缪干贲钮嵇滑翁荀羊惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘厉戎祖武符景詹束龙幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍却璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公丘覃佟"
# Characters of grammar and of common verbs, which names do not have.
NO_NAME = "的了着过说道问是在不我你您他她它们这那有没和与就也都把被让给吗呢吧啊呀来去要回写寄收请找领拿取买借补看见到从向对为以及或但而又再还很最太更第个只本一二三四五六七八九十百千万号楼室路街市省区县单元栋"
COMPOUND = "欧阳 上官 司马 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 宇文 长孙 夏侯 司徒 司空 端木 轩辕 南宫 闻人 申屠 独孤 百里".split()
GIVEN = "伟刚勇毅俊峰强军平保东文辉力明永健世广志义兴良海山仁波宁贵福生龙元全国胜学祥才发武新利清飞彬富顺信子杰涛昌成康星光天达安岩中茂进林有坚和彪博诚先敬震振壮会思群豪心邦承乐绍功松善厚庆磊民友裕河哲江超浩亮政谦亨奇固之轮翰朗伯宏言若鸣朋斌梁栋维启克伦翔旭鹏泽晨辰士以建家致树炎德行时泰盛雄琛钧冠策腾楠榕风航弘秀娟英华慧巧美娜静淑惠珠翠雅芝玉萍红娥玲芬芳燕彩春菊兰凤洁梅琳素云莲真环雪荣爱妹霞香月莺媛艳瑞凡佳"
MORE_GIVEN = "一可梓涵轩宇然欣怡诗雨梦瑶语嫣曦诺依奕宸睿铭昊逸沐阳皓煜祺晟熙彤萱蕊蕾薇岚棠芷芸苒茜菡莹婷婉婧娴嘉妍姝晴晗晓昕昱景智朔望柔柏桐楚榆樱橙欢歌毓沁沛泓洋洲润淇淳渊湘溪滢漫澄澈澜瀚灿炜烨焕煊熠玥玮珂珊珏珺琦琬琰琪瑜瑾璇璐璟画白皎碧禾秋竹笑简绮绫绯纯纾衿鸢鹤鹿麟念忆恒悠慈惜意懿南北西乔书仪佑俐倩允冉冬初勋千卿又叶含吟咏唯如妤尧尔屿峥崇巍帆帅年庭弈归忻怀悦愉拓拾挽晏暖木朵杉果枫柠柯梵森楷槿殊水沅沫泊洛淮渝湛溯漪灵烁照熹爽牧玄珩琅甜畅盈盼睦知砚祎禹穗童笛筠筱紫罗翊翎耀聆舒舟艺芊芙苇苏茉茗莎莞葵蓓蓝蔚蕴藤虹蝶衡襄诣谊谨贝贤赫越轶迅远逍遥遇道邈郁郡采野铃锐锦镜长闻阅阔隽雁霁霏霖露青非韵韬韶顾颂颖飒馨驰骁骏骞魁鲲鸾黎默"
FAMILY_JA = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田 松田 竹内 小野 田村 中山 和田 石田 森田 上田 原 内田 柴田 酒井 宮崎 横山 高木 安藤 宮本 大野 小島 工藤 谷口 今井 高田 増田 丸山 杉山 村田 大塚 新井 小山 平野 藤本 河野 上野 野口 武田 松井 千葉 菅原 岩崎 久保".split()
KANJI = "山川田中村木林森石松竹梅桜藤原野島崎井上下東西南北大小高長永安平和光明正直清水泉池谷沢橋岡坂浜浦津宮本元古新黒白青赤金銀星月日夏冬春秋風雪雨雲空海陸陽輝翔太郎一二三子美恵由紀奈菜花香里織彩佳智博健誠浩隆修豊亮介樹真理央結愛優希葵蓮悠斗"
MORE_KANJI = "霧朔灯凪柊砂瀬湊凛翼楓葉茜紗沙綾絵梨桃李杏茉莉萌咲実穂稲麦米桑栗柿柚橘椿榊榎楠桐檜柏槙梓柳萩蘭堀溝渡港潮波渚磯岸岬峰嶺岳丘塚堤淵滝河江湖沼潟雫露霜霞虹朝夕宵夜暁旭昇晴嵐颯凌冴氷蒼碧翠朱紅緋墨鉄玉珠璃琥珀琴笛鈴弓矢剣旗鳥鶴鷹鷺雁燕亀龍虎熊鹿馬兎狐羊鯨鯉蝶蛍千百万八九五六七四参常磐相宇志乃之助吾次朗雄男彦治信義忠孝礼仁勇武賢敏聡洋寛弘広泰康寿福幸喜楽笑思念祈夢玄衣音律奏詩"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"
FIRST = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Kenneth Carol George Ruth Joshua Helen Kevin Laura Brian Anna Edward Grace Ronald Alice Peter Julia Hans Greta Jürgen Ute Klaus Heike Pierre Amélie Luc Chloé Carlos Lucía Pablo Inés".split()
LAST = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Schmidt Müller Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Dubois Moreau Lefèvre Rousseau Girard García Fernández López Moreno Ortega Navarro".split()
FIRST_RU = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Павел Виктор Олег Игорь Вера Нина Лев Фёдор Григорий Глеб Зоя Тимофей".split()
LAST_RU = "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев Орлов Андреев Макаров Никитин Захаров".split()
PLACES_ZH = "北京 上海 广州 深圳 天津 重庆 成都 武汉 西安 南京 杭州 苏州 长沙 郑州 青岛 大连 厦门 宁波 昆明 合肥 福州 济南 沈阳 哈尔滨 长春 石家庄 太原 南宁 贵阳 兰州 海口 银川 西宁 无锡 佛山 东莞".split()
PROVINCES = "河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海".split()
PLACE_CHARS = "东西南北中上下大小新老山水河江湖海溪泉石金银玉龙凤鹤马牛羊桃李杏梅松柏竹柳杨桂兰荷莲花园林田村庄家和平安宁福寿康乐人民解放建设光明文化学府青年工农胜利友谊长春夏秋冬阳光朝晨星月云风雨雪清永兴昌盛华国泰丰城关门桥塔寺庙港湾洲岛岭坡沟坪坝塘滩"
MORE_PLACE_CHARS = "盐磨听望渡鹭砚沉香梧桐旧井碑亭楼台阁观堂祠集仓窑坑矿铁铜锡煤木茶酒米粮布丝染纺织瓦砖灰浦埠码津汀渚池潭渊潮浪波流源渠堰堤闸峡谷崖峰冈岗丘陵原野坳洞岩白蓝紫黑黄红翠碧丹朱赤乌雁鸥燕雀莺鹰鹿虎狮象鱼蚕菊枫槐榆桑樟榕楠椿棠梨橘枣茉莉芙蓉蔷薇菱苇芦蒲藕豆麦稻禾圃方正高前后内外头口角岸环双"
PREFECTURES = "東京都 北海道 京都府 大阪府 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 神奈川県 新潟県 富山県 石川県 長野県 岐阜県 静岡県 愛知県 三重県 兵庫県 奈良県 岡山県 広島県 香川県 愛媛県 福岡県 熊本県 沖縄県".split()
HOST_ENDS = "com net org cn com.cn de ru jp co.jp fr es edu io info me co.uk example test invalid example.com example.org localhost.test".split()
_HAN_DIGITS = "〇一二三四五六七八九"
_CONSONANTS, _VOWELS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl gr kl pl pr sh sl st th tr".split(), "a e i o u a e i o ai ea ee ie oo ou ä ö ü é".split()
_ENDS = "n r l s t d m ck ld nd ng nt rd rn rt ss st th x y".split()
_RU_ON, _RU_IN = "б в г д ж з к л м н п р с т ф х ц ч ш бр вл гр др кр пл пр св сл сн ст тр".split(), "а е и о у ы ю я".split()


class Values:
    """Draws values of every kind."""

    def __init__(self, rng: np.random.Generator, corpus: list[str] = ()):
        self.rng = rng
        words = lambda pattern: sorted({w for x in corpus for w in re.findall(pattern, x)})[:4000]
        # A name of the story may be a reader's as well: what is around it decides.
        self.story = {"latin": words(r"\b[A-ZÀ-Þ][a-zà-ÿ]{3,}\b"), "ru": words(r"\b[А-Я][а-яё]{3,}\b"), "han": [c for c in words(r"[一-鿿]") if c not in NO_NAME]}

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def char(self, name: str, common: float) -> str:
        return self.pick(globals()[name if self.chance(common) else f"MORE_{name}"])

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def num(self, top: int = 400) -> str:
        return str(int(self.rng.integers(1, top)))

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def wide(self, s: str, p: float = 0.12) -> str:
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() or c in "-－" else c for c in s) if self.chance(p) else s

    def latin(self) -> str:
        """A word as a name: a made-up one, or one of the corpus."""
        if self.story["latin"] and self.chance(0.12):
            return self.pick(self.story["latin"])
        return "".join(self.pick(_CONSONANTS) + self.pick(_VOWELS) + (self.pick(_ENDS) if self.chance(0.45) else "") for _ in range(int(self.rng.integers(1, 4)))).capitalize()

    def cyrillic(self) -> str:
        if self.story["ru"] and self.chance(0.2):
            return self.pick(self.story["ru"])
        return "".join(self.pick(_RU_ON) + self.pick(_RU_IN) + (self.pick("в л м н р с т й".split()) if self.chance(0.3) else "") for _ in range(int(self.rng.integers(1, 4)))).capitalize()

    def han(self, n: int) -> str:
        """Characters of a name: common ones, any of the corpus, any at all."""
        one = lambda x: self.char("GIVEN", 0.55) if x < 0.6 or not self.story["han"] else self.pick(self.story["han"]) if x < 0.88 else chr(int(self.rng.integers(0x4E00, 0x9F00)))
        return "".join(one(self.rng.random()) for _ in range(n))

    def kanji(self, n: int = 2) -> str:
        one = lambda x: self.char("KANJI", 0.65) if x < 0.8 or not self.story["han"] else self.pick(self.story["han"]) if x < 0.95 else chr(int(self.rng.integers(0x4E00, 0x9F00)))
        return "".join(one(self.rng.random()) for _ in range(n))

    def person(self, lang: str) -> str:
        if lang == "zh":
            given = self.han(1 + self.chance(0.7))
            return (self.pick(COMPOUND) if self.chance(0.15) else self.char("SURNAMES", 0.6) if self.chance(0.9) else self.han(1)) + given
        if lang == "ja":
            family = self.pick(FAMILY_JA) if self.chance(0.4) else self.kanji(2 + self.chance(0.08))
            given = "".join(self.pick(KANA) for _ in range(2 + self.chance(0.6))) if self.chance(0.35) else self.kanji(1 + self.chance(0.7))
            return family + self.pick([" ", " ", "", "", "　"]) + given
        if lang == "ru":
            first = self.pick(FIRST_RU) if self.chance(0.4) else self.cyrillic()
            last = self.pick(LAST_RU) + self.pick(["", "а"]) if self.chance(0.4) else self.cyrillic() + self.pick("ов ова ев ева ин ина ский ская цкий ко ук ич".split())
            return first + " " + (self.pick(FIRST_RU)[:1] + ". " if self.chance(0.1) else "") + last
        first = self.pick(FIRST) if self.chance(0.45) else self.latin()
        last = self.pick(LAST) if self.chance(0.4) else self.pick([self.latin, self.latin, lambda: self.latin() + "-" + self.latin(), lambda: self.pick(["O’", "O'", "Mc", "D’"]) + self.latin(), lambda: self.pick(["van ", "von ", "de ", "van der "]) + self.latin()])()
        return first + " " + (self.latin()[:1] + ". " if self.chance(0.1) else "") + last

    def email(self, lang: str = "en") -> str:
        part = lambda: self.pick(FIRST + LAST).lower().encode("ascii", "ignore").decode() if self.chance(0.4) else "".join(self.pick(_CONSONANTS) + self.pick("aeiou") for _ in range(int(self.rng.integers(1, 4))))
        user = self.pick(["", "", part() + ".", part() + "_", part() + "-", part()[:1] + ".", part() + "+"]) + part() + (self.digits(int(self.rng.integers(1, 5))) if self.chance(0.4) else "")
        host = part() + self.pick(["", "", "-" + part(), "." + part()]) + "." + self.pick(HOST_ENDS)
        form = self.rng.random()
        if form < 0.62:
            return f"{user}@{host}".upper() if self.chance(0.1) else f"{user}@{host}"
        if form < 0.7:
            return f"{user} @ {host}"
        if form < 0.8:
            at, dot = self.pick([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")])
            return user + at + host.replace(".", dot)
        if form < 0.88:
            return f"{user}{self.pick(['(at)', '[at]', ' (at) '])}{host}"
        return f"{user}＠{host.replace('.', '．') if self.chance(0.6) else host}"

    def phone(self, lang: str) -> str:
        d = self.digits
        if lang == "zh":
            a, b, c = "1" + d(2), d(4), d(4)
            s = self.pick([a + b + c, a + b + c, f"{a}-{b}-{c}", f"{a} {b} {c}", f"+86 {a}{b}{c}", f"+86-{a}-{b}-{c}", f"(+86){a}-{b}{c}", f"0{d(3)}-{d(7)}", f"0{d(3)}-{d(7)}转{d(3)}", f"0{d(2)}-{d(8)}", f"(0{d(2)}){d(8)}", f"400-{d(3)}-{d(4)}"])
            return "".join(_HAN_DIGITS[int(x)] for x in a + b + c) if self.chance(0.08) else self.wide(s)
        if lang == "ja":
            return self.wide(self.pick([f"0{d(2)}-{d(4)}-{d(4)}", f"+81 {d(2)} {d(4)} {d(4)}", f"+81-{d(2)}-{d(4)}-{d(4)}", f"0{d(1)}-{d(4)}-{d(4)}", f"0{d(2)}－{d(4)}－{d(4)}", f"0{d(3)}-{d(2)}-{d(4)}"]))
        if lang == "de":
            return self.pick([f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(2)}/{d(8)}", f"0{d(3)} {d(6)}"])
        if lang == "ru":
            return self.pick([f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+7 {d(3)} {d(3)} {d(2)} {d(2)}", f"8 {d(3)} {d(3)} {d(2)} {d(2)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}"])
        if lang in ("fr", "es"):
            return self.pick([f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(2)} {d(2)} {d(2)}"])
        return self.pick([f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(4)} {d(6)}", f"+44 {d(4)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)} ext. {d(3)}", f"{d(3)}-{d(3)}-{d(4)} ext {d(3)}"])

    def id(self, lang: str) -> str:
        if lang == "zh" or self.chance(0.35):
            a, y, m, e = d = self.digits(6), str(self.pick([19, 20])) + self.digits(2), self.digits(4), self.digits(3) + self.pick("0123456789X")
            return self.wide(self.pick(["".join(d), "".join(d), f"{a}-{y}-{m}-{e}", f"{a} {y}{m} {e}", f"{a} {y} {m} {e}", a + y[2:] + m + self.digits(3)]))
        return self.pick(["{}-{}-{}", "{} {} {}"]).format(self.digits(3), self.digits(2), self.digits(4))

    def address(self, lang: str) -> str:
        n = self.num
        if lang == "zh":
            place = lambda k: "".join(self.char("PLACE_CHARS", 0.65) if self.chance(0.85) else self.han(1) for _ in range(k))
            city = self.pick(PLACES_ZH) if self.chance(0.3) else place(2)
            s = ((self.pick(PROVINCES) if self.chance(0.5) else place(2)) + "省") * self.chance(0.35) + (city + "市") * self.chance(0.7) + (place(2) + self.pick("区 区 县".split())) * self.chance(0.5)
            s += (place(2) + self.pick("镇 乡 街道".split())) * self.chance(0.08)
            s += place(2 + self.chance(0.25)) + self.pick("路 路 街 大街 巷 大道 里 道 胡同 弄 东路 西街 北路 南街 村".split()) + n() + self.pick(["号", "号", "号", "弄", "-" + n(30) + "号"])
            s += self.pick(["", "", "", f"{n(12)}号楼{n(6)}单元{n()}室", f"{n(12)}栋{n()}室", f"{n(12)}-{n(6)}-{n()}", f"{n(12)}号楼{n()}室", f"{n(20)}幢{n(5)}单元{n()}", f"{place(2)}大厦{n(30)}层", f"{place(2)}小区{n(30)}栋{n()}", f"{n()}室"])
            return self.wide(s, 0.15)
        if lang == "ja":
            head = self.pick(PREFECTURES) if self.chance(0.45) else self.kanji() + "県"
            return self.wide(head + self.kanji() + self.pick("市 市 郡 区".split()) + self.kanji(1 + self.chance(0.7)) + self.pick(["町", "町", "", "村"]) + self.pick([f"{n(9)}丁目{n(30)}-{n(30)}", f"{n(9)}-{n(30)}-{n(30)}", f"{n(9)}丁目{n(30)}番{n(30)}号", f"{n(999)}番地", f"{n(9)}丁目{n(30)}-{n(30)} {n(900)}号室"]), 0.1)
        if lang == "de":
            street = self.pick([self.latin() + self.pick("straße weg gasse allee platz str. ring".split()), self.pick(["Am ", "Alte ", "Zum ", "An der "]) + self.latin(), self.latin() + "er " + self.pick(["Straße", "Weg", "Allee"]), "Alte " + self.latin() + "gasse"])
            return f"{street} {n()}{self.pick(['', '', 'a', 'b'])}, {self.digits(5)} {self.latin()}"
        if lang == "ru":
            town = self.pick(["г. ", "г. ", "пос. "]) + self.cyrillic() + self.pick(["", "-" + self.cyrillic(), "ск"])
            street = self.pick(["ул. ", "ул. ", "пр. ", "пер. "]) + self.cyrillic() + f", {self.pick(['д. ', 'дом '])}{n()}" + self.pick(["", "", f", кв. {n(99)}", f", корп. {n(5)}"])
            return self.pick(["", "", self.digits(6) + ", "]) + self.pick([f"{street}, {town}", f"{town}, {street}"])
        if lang in ("fr", "es"):
            street = self.pick([f"{n()} {self.pick(['rue', 'avenue', 'place', 'boulevard'])} {self.pick(['', 'de ', 'des ', 'du '])}{self.latin()}", f"{self.pick(['Calle', 'Avenida', 'Plaza'])} {self.pick(['', 'de ', 'del '])}{self.latin()} {n()}"])
            return f"{street}, {self.digits(5)} {self.latin()}"
        s = n(9999 if self.chance(0.3) else 400) + self.pick(["", "", "", "a", "b"]) + " " + self.pick(["", "", "Old ", "North ", "West "]) + self.latin() + self.pick(["", "", " " + self.latin()]) + " " + self.pick("Road Lane Street Avenue Ave. Ave St St. Rd Drive Court Place Square Way Row Terrace Close Hill Walk Stair Crescent Boulevard".split())
        s += self.pick(["", "", f", Apt {n(99)}", f", Flat {n(9)}", f", Apt. {n(20)}", f", Suite {n()}", f", Unit {n(40)}"])
        state = self.pick("ABCDFGIKLMNOPQRSTUVWX") + self.pick("ACDEIJKLNORSTVXYZ")
        return s + self.pick(["", f", {self.latin()}", f", {self.latin()}, {state} {self.digits(5)}", f", {self.latin()}, {state} {self.digits(5)}", f", {self.latin()} {state}{n(20)} {n(9)}{state}"])


def _fill(sentence: str, lang: str, v: Values) -> tuple[str, list[tuple[int, int, int]]]:
    for _ in range(2):  # a word may hold another class
        sentence = re.sub(r"<(\w+)>", lambda m: v.pick(WORDS[lang][m[1]]), sentence)
    text, spans = "", []
    for part in re.split(r"(\{\w+\})", sentence):
        if part[:1] != "{":
            text += part
            continue
        kind = {"id": "id_number"}.get(part[1:-1], part[1:-1])
        value = getattr(v, part[1:-1])(lang)
        spans.append((len(text), len(text) + len(value), KINDS.index(kind)))
        text += value
    return text, spans


def _record(lang: str, v: Values) -> str:
    """One to four fields, each a label and a value."""
    wide = lang in ("zh", "ja")
    colon = v.pick(["：", "：", ":", " ", "为", "是"] if lang == "zh" else ["：", "：", ":", " ", "は"] if wide else [": ", ": ", " ", ":"])
    fields = [v.pick(LABELS[lang][k]) + colon + "{" + k.removesuffix("_number") + "}" for k in v.rng.permutation(KINDS)[: 1 + int(v.rng.integers(0, 4))]]
    out = v.pick(["，", "；", "，", " ", "/"] if lang == "zh" else ["、", "、", " ", "／"] if wide else [", ", "; ", " | ", ". "]).join(fields)
    out = v.pick(["（{}）", "【{}】", "({})", "{}", "{}", "{}"]).format(out.replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")
    return out + v.pick(["", "", "。" if wide else "."])


def _negative(sentence: str, v: Values) -> str:
    def one(m: re.Match) -> str:
        k = m[1]
        if k in ("latin", "low"):
            return v.latin() if k == "latin" else v.latin().lower()
        if k in ("han", "kanji"):
            return v.person("zh") if k == "han" and v.chance(0.6) else v.han(2) if k == "han" else v.kanji()
        return v.cyrillic() if k == "cyr" else v.latin().lower() + ".example" if k == "site" else v.digits(int(k[1:])) if k[0] == "d" else v.num(10 if k == "n" else 99)

    return re.sub(r"\{(\w+)\}", one, sentence)


def _numbered(v: Values) -> str:
    """A number that is none of a person: of an order, a group, a book."""
    lang = v.pick(list(NUMBERED))
    d, label = v.digits, v.pick(NUMBERED[lang])
    number = v.pick([d(int(v.rng.integers(4, 18))), d(int(v.rng.integers(8, 14))), f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{v.num(10)}-{d(3)}-{d(5)}-{v.num(10)}", f"{v.num(20)}.{v.num(300)}.{v.num(100)}", f"{v.pick('ABCXYZ')}{d(7)}", f"20{d(2)}-{d(6)}"])
    wide = lang in ("zh", "ja")
    out = (label if wide else v.pick([label, label.capitalize()])) + v.pick(["：", ":", " ", "", "为"] if lang == "zh" else ["：", " ", "は", ""] if wide else [": ", " ", " no. "]) + v.wide(number)
    return v.pick(["", "", "本书", "新", "本店", "附"] if lang == "zh" else [""]) + out + v.pick(["，请看公告。", "。", "", "已发出。", "，勿外传"] if lang == "zh" else ["。", "です。", ""] if wide else [".", "", ", see below.", f", vol. {v.num(9)}."])


def _script(line: str) -> str:
    """Script of most letters of a line, by the first word of their names."""
    seen: dict[str, int] = {}
    for c in line[:60]:
        if c.isalpha():
            name = unicodedata.name(c, "other").split()[0]
            seen[name] = seen.get(name, 0) + 1
    return max(sorted(seen), key=lambda k: seen[k]) if seen else "none"


def cues() -> re.Pattern:
    """Words around values, and forms of values: corpus lines that have any are not taught as free of values."""
    words = {w for of in (*LABELS.values(), *WORDS.values()) for xs in of.values() for w in xs}
    words |= {p.strip(" ，。、：:,.;!！？?") for xs in POSITIVE.values() for s in re.split(r"[|\n]", xs) for p in re.split(r"\{\w+\}|<\w+>", s)}
    plain = {w for w in words if (len(w) >= 2 and re.search("[一-鿿ァ-ヶ]", w)) or (len(w) >= 5 and w[0] < "⺀" and not w.islower())}
    records = r"|(?:^|[\s。；！？”」）)])[^\s，。：:；！？“”「」\"]{2,12}(?:[：:](?!\s*[“「『\"‘])|: )"  # a label and a colon, unless speech follows
    signed = r"|(?:^|[。！？”」\s])(?:——|—|――)\s?\S{2,12}"
    own = "Dank_an 我住 我叫 我是 名叫 申します heiße m’appelle llamo зовут name_is I_am".split()
    return re.compile("|".join(re.escape(w.replace("_", " ")) for w in sorted(plain | set(own), key=lambda w: (-len(w), w))) + r"|[@＠]|[\[(]at[\])]|[\d０-９][\d０-９ .()-]{6,}|[\d０-９][号丁番室]|\b(?:ул|кв|д)\. |\d{5} [A-Z]|\d[a-z]? (?:\w+ ){1,3}(?:Road|Lane|Street|St\b|Ave|Row|Court|Drive|Place|Square|Way|Terrace|Close|Hill|Walk|Crescent)|\w(?:straße|weg|gasse|allee|platz) \d|[〇一二三四五六七八九]{7}" + records + signed)


def examples(n: int, corpus_lines: list[str], seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` lines with their spans (start, end, kind), nine of twenty with values, mixed with lines of the corpus."""
    rng = np.random.default_rng(seed)
    v = Values(rng, corpus_lines)
    positive = {lang: re.split(r"[|\n]", xs) for lang, xs in POSITIVE.items()}
    langs = list(positive)
    weight = np.array([{"zh": 9.0, "en": 6.0, "fr": 1.0, "es": 1.0}.get(lang, 4.0) for lang in langs])
    negative = re.split(r"[|\n]", NEGATIVE)
    hidden = cues()
    plain = [x for x in corpus_lines if x.strip() and not hidden.search(x)]
    by_script: dict[str, list[str]] = {}
    for x in plain:
        by_script.setdefault(_script(x), []).append(x)
    scripts = sorted(by_script)
    often = np.array([{"LATIN": 6.0, "CJK": 3.0, "CYRILLIC": 2.0, "HIRAGANA": 2.0}.get(x, 0.4) for x in scripts])
    line = lambda: v.pick(by_script[scripts[int(rng.choice(len(scripts), p=often / often.sum()))]])
    beside = {"zh": "CJK", "ja": "HIRAGANA", "ru": "CYRILLIC"}
    out = []
    for i in range(n):
        kind, near = i % 20, None
        if kind < 9:
            lang = langs[int(rng.choice(len(langs), p=weight / weight.sum()))]
            near = by_script.get(beside.get(lang, "LATIN")) if rng.random() < 0.7 else None
            text, spans = _fill(_record(lang, v) if kind < 2 else v.pick(positive[lang]), lang, v)
        elif kind < 12 or not plain:
            text, spans = _numbered(v) if rng.random() < 0.2 else _negative(v.pick(negative), v), []
        else:
            x = line()
            at = int(rng.integers(0, max(1, len(x) - 60)))
            out.append((x[at : at + 90], []))
            continue
        if near and spans and rng.random() < 0.15:
            # Any text may follow a value, and come before one whose form is enough: what is close to it decides.
            last = spans[-1][1]
            text = text[: last + int(rng.integers(0, 4))] + v.pick(near)[int(rng.integers(0, 20)) :][:30]
            if spans[0][2] != KINDS.index("person") and rng.random() < 0.5:
                head = v.pick(near)[-int(rng.integers(4, 30)) :]
                cut = max(0, spans[0][0] - int(rng.integers(0, 4)))
                text, spans = head + text[cut:], [(a + len(head) - cut, b + len(head) - cut, k) for a, b, k in spans]
        if plain and rng.random() < 0.35:
            before = (v.pick(near) if near else line())[-int(rng.integers(5, 40)) :] + v.pick(["", "；", " ", "", "」", "　　", "。"])
            text, spans = before + text, [(a + len(before), b + len(before), k) for a, b, k in spans]
        if rng.random() < 0.12:
            text, spans = "（" + text, [(a + 1, b + 1, k) for a, b, k in spans]
        if plain and rng.random() < 0.35:
            text += v.pick(["；", " ", "", "　　"]) + (v.pick(near) if near else line())[: int(rng.integers(5, 40))]
        out.append((text, spans))
    return out
