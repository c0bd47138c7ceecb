"""The vocabularies that extraction and gating are defined by.

They are requirements, not logic: word lists, rates and patterns that results depend on, stated as text in their
natural order. `listed` and `pairs` read them.
"""

from __future__ import annotations


def listed(text: str, sep: str | None = None) -> list[str]:
    return [x.strip() for x in text.strip().split(sep) if x.strip()]


def pairs(text: str) -> dict[str, str]:
    """'key=value, key=value' as a dict."""
    return {k.strip(): v.strip() for k, v in (x.split("=") for x in text.replace("\n", " ").split(",") if x.strip())}


# ---- money ---------------------------------------------------------------------------------------------------------
# US dollars per unit of currency, and their date.
FX_DATE = "2026-09-01"
FX = pairs("""
    USD=1.0, EUR=1.08, GBP=1.27, CHF=1.12, CAD=0.73, AUD=0.66, NZD=0.61, SGD=0.74, HKD=0.128, JPY=0.0066, CNY=0.138,
    KRW=0.00073, TWD=0.031, INR=0.0120, PKR=0.0036, BDT=0.0085, LKR=0.0033, NPR=0.0075, AED=0.2723, SAR=0.2666,
    QAR=0.2747, KWD=3.25, BHD=2.65, OMR=2.60, ILS=0.27, TRY=0.030, EGP=0.021, ZAR=0.054, NGN=0.00065, KES=0.0077,
    GHS=0.065, MAD=0.10, TND=0.32, BRL=0.19, MXN=0.055, ARS=0.0011, CLP=0.0011, COP=0.00025, PEN=0.27, UYU=0.025,
    SEK=0.095, NOK=0.093, DKK=0.145, PLN=0.25, CZK=0.043, HUF=0.0028, RON=0.22, BGN=0.55, UAH=0.024, RUB=0.011,
    IDR=0.000062, MYR=0.22, THB=0.028, PHP=0.0175, VND=0.000039""")
# Symbols and words of currencies.
CURRENCY_TOKENS = pairs("""
    $=USD, us$=USD, usd=USD, u.s.$=USD, dollars=USD, dollar=USD, €=EUR, eur=EUR, euro=EUR, euros=EUR,
    £=GBP, gbp=GBP, pound=GBP, pounds=GBP, sterling=GBP, ₹=INR, inr=INR, rs=INR, rs.=INR, rupees=INR, rupee=INR,
    ₨=PKR, pkr=PKR, aed=AED, dh=AED, dhs=AED, dirham=AED, dirhams=AED, sar=SAR, qar=QAR, kwd=KWD, bhd=BHD, omr=OMR,
    s$=SGD, sgd=SGD, sg$=SGD, a$=AUD, aud=AUD, au$=AUD, c$=CAD, cad=CAD, ca$=CAD, nz$=NZD, nzd=NZD, hk$=HKD, hkd=HKD,
    r$=BRL, brl=BRL, reais=BRL, real=BRL, mxn=MXN, mx$=MXN, ¥=JPY, jpy=JPY, yen=JPY, cny=CNY, rmb=CNY, yuan=CNY,
    krw=KRW, ₩=KRW, won=KRW, ₪=ILS, ils=ILS, nis=ILS, shekel=ILS, shekels=ILS, ₺=TRY, try=TRY, lira=TRY, liras=TRY,
    tl=TRY, ₦=NGN, ngn=NGN, naira=NGN, ksh=KES, kes=KES, shilling=KES, shillings=KES, zar=ZAR, rand=ZAR, egp=EGP,
    ghs=GHS, mad=MAD, tnd=TND, sek=SEK, kronor=SEK, nok=NOK, kroner=NOK, dkk=DKK, kronen=DKK, pln=PLN, zł=PLN,
    zloty=PLN, złotych=PLN, zlotych=PLN, złoty=PLN, czk=CZK, koruna=CZK, huf=HUF, forint=HUF, ron=RON, lei=RON,
    bgn=BGN, uah=UAH, ₴=UAH, hryvnia=UAH, rub=RUB, ₽=RUB, rubles=RUB, rouble=RUB, idr=IDR, rp=IDR, rupiah=IDR,
    myr=MYR, rm=MYR, ringgit=MYR, thb=THB, ฿=THB, baht=THB, php=PHP, ₱=PHP, peso=PHP, pesos=PHP, vnd=VND, ₫=VND,
    dong=VND, chf=CHF, francs=CHF, franken=CHF, riyals=SAR, riyal=SAR, soles=PEN, taka=BDT, twd=TWD, clp=CLP,
    cop=COP, pen=PEN, ars=ARS, lkr=LKR, bdt=BDT, npr=NPR, uyu=UYU""")
# Words that several countries share, and the bare dollar with the local dollars it may mean.
AMBIGUOUS_TOKENS = listed(
    "peso pesos rupee rupees rs rs. krona kronor krone kroner kronen franc francs franken shilling shillings riyal riyals"
    " dinar dinars pound pounds lira liras real"
)
DOLLAR_TOKENS = ["$", "dollar", "dollars"]
LOCAL_DOLLARS = listed("SGD AUD CAD NZD HKD TWD")
# Currencies of places and of nationalities.
PLACE_CURRENCY = pairs("""
    india=INR, pakistan=PKR, bangladesh=BDT, sri lanka=LKR, nepal=NPR, uae=AED, united arab emirates=AED, dubai=AED,
    abu dhabi=AED, saudi=SAR, qatar=QAR, kuwait=KWD, bahrain=BHD, oman=OMR, singapore=SGD, australia=AUD,
    new zealand=NZD, canada=CAD, hong kong=HKD, japan=JPY, china=CNY, south korea=KRW, taiwan=TWD, brazil=BRL,
    mexico=MXN, chile=CLP, colombia=COP, peru=PEN, argentina=ARS, nigeria=NGN, kenya=KES, south africa=ZAR, ghana=GHS,
    egypt=EGP, morocco=MAD, tunisia=TND, israel=ILS, turkey=TRY, sweden=SEK, norway=NOK, denmark=DKK, poland=PLN,
    czech=CZK, hungary=HUF, romania=RON, bulgaria=BGN, ukraine=UAH, indonesia=IDR, malaysia=MYR, thailand=THB,
    philippines=PHP, vietnam=VND, switzerland=CHF, uruguay=UYU, bengaluru=INR, bangalore=INR, mumbai=INR,
    new delhi=INR, gurugram=INR, gurgaon=INR, noida=INR, hyderabad=INR, pune=INR, chennai=INR, kolkata=INR,
    ahmedabad=INR, karachi=PKR, lahore=PKR, islamabad=PKR, dhaka=BDT, colombo=LKR, kathmandu=NPR, stockholm=SEK,
    gothenburg=SEK, oslo=NOK, copenhagen=DKK, mexico city=MXN, guadalajara=MXN, monterrey=MXN, bogota=COP, bogotá=COP,
    medellin=COP, medellín=COP, lima=PEN, santiago=CLP, buenos aires=ARS, montevideo=UYU, sao paulo=BRL,
    são paulo=BRL, rio de janeiro=BRL, lagos=NGN, abuja=NGN, nairobi=KES, accra=GHS, cape town=ZAR, johannesburg=ZAR,
    cairo=EGP, casablanca=MAD, istanbul=TRY, ankara=TRY, tel aviv=ILS, jakarta=IDR, kuala lumpur=MYR, bangkok=THB,
    manila=PHP, ho chi minh city=VND, hanoi=VND, zurich=CHF, geneva=CHF, warsaw=PLN, krakow=PLN, kraków=PLN,
    prague=CZK, budapest=HUF""")
DEMONYM_CURRENCY = pairs("""
    indian=INR, pakistani=PKR, bangladeshi=BDT, sri lankan=LKR, nepali=NPR, emirati=AED, saudi arabian=SAR,
    qatari=QAR, kuwaiti=KWD, bahraini=BHD, omani=OMR, israeli=ILS, turkish=TRY, singaporean=SGD, australian=AUD,
    new zealander=NZD, canadian=CAD, japanese=JPY, chinese=CNY, korean=KRW, taiwanese=TWD, brazilian=BRL, mexican=MXN,
    chilean=CLP, colombian=COP, peruvian=PEN, argentine=ARS, argentinian=ARS, uruguayan=UYU, nigerian=NGN,
    kenyan=KES, south african=ZAR, ghanaian=GHS, egyptian=EGP, moroccan=MAD, tunisian=TND, swedish=SEK, norwegian=NOK,
    danish=DKK, polish=PLN, czech=CZK, hungarian=HUF, romanian=RON, bulgarian=BGN, ukrainian=UAH, russian=RUB,
    swiss=CHF, indonesian=IDR, malaysian=MYR, thai=THB, filipino=PHP, philippine=PHP, vietnamese=VND, british=GBP,
    english=GBP, scottish=GBP, welsh=GBP, french=EUR, german=EUR, dutch=EUR, spanish=EUR, italian=EUR,
    portuguese=EUR, irish=EUR, belgian=EUR, austrian=EUR, finnish=EUR, greek=EUR, estonian=EUR, latvian=EUR,
    lithuanian=EUR, slovak=EUR, slovenian=EUR, croatian=EUR""")
# Factors of multipliers.
MULTIPLIERS = pairs("""
    k=1e3, thousand=1e3, m=1e6, mn=1e6, mm=1e6, mio=1e6, million=1e6, millions=1e6, millionen=1e6, millionene=1e6,
    millón=1e6, millones=1e6, milhão=1e6, milhões=1e6, milhao=1e6, milhoes=1e6, milione=1e6, milioni=1e6, miljoen=1e6,
    miljoenen=1e6, miljon=1e6, miljoner=1e6, millioner=1e6, miljoona=1e6, miljoonaa=1e6, milion=1e6, miliony=1e6,
    milionów=1e6, milionow=1e6, milyon=1e6, juta=1e6, bn=1e9, b=1e9, billion=1e9, billions=1e9, milliarde=1e9,
    milliarden=1e9, milliard=1e9, miliardi=1e9, mil millones=1e9, milyar=1e9, miliar=1e9, lakh=1e5, lakhs=1e5,
    lac=1e5, lacs=1e5, crore=1e7, crores=1e7, cr=1e7""")
# Currency signs and codes as they are written beside a figure.
MONEY_SIGNS = listed("US$ A$ C$ S$ NZ$ HK$ R$ MX$ SG$ AU$ CA$ $ € £ ₹ ₨ ¥ ₩ ₪ ₺ ₦ ₴ ₽ ₱ ₫ ฿ zł")
MONEY_CODES = listed(
    "USD EUR GBP INR PKR AED SAR QAR KWD BHD OMR SGD AUD CAD NZD HKD JPY CNY RMB KRW TWD ILS NIS TRY TL EGP ZAR NGN KES"
    " GHS MAD TND BRL MXN ARS CLP COP PEN UYU SEK NOK DKK PLN CZK HUF RON BGN UAH RUB IDR MYR THB PHP VND CHF LKR BDT NPR"
    " Rs. Rs Rp RM Ksh Dhs Dh euros euro pounds pound sterling dollars dollar reais real złotych zlotych złoty kronor"
    " kroner kronen francs franken dirhams dirham riyals riyal shekels shekel rupees rupee rupiah ringgit baht pesos"
    " peso soles liras lira naira shillings shilling yen yuan won dong taka kyat lei forint koruna hryvnia rubles rouble"
)
# Phrases that tell what a figure measures, one class after another in the order they are tested.
AMOUNT_PHRASES = {
    "valuation": "valuation|valued at|post-money|pre-money|post money|pre money|market cap|market capitalisation|market capitalization|worth an estimated|enterprise value|unicorn status|at a valuation",
    "tam": "addressable market|market size|market is worth|market worth|tam|market opportunity|industry is worth|market is expected to reach|market is projected|sector is worth|global market",
    "aum": "assets under management|aum|assets under advisory",
    "acv": "contract value|acv|average deal|deal size|per contract|annual contract|contract with|supply contract|won a contract|signed a contract|contract to supply|framework agreement",
    "fund_size": "maiden fund|debut fund|venture fund|new fund|first fund|corpus|investment vehicle|limited partners| lps |投资基金|fund i|fund ii|fund iii|close of its fund|closes its fund|closed its fund|launches a fund|launched a fund|raises a fund|raised a fund|fund to invest|fund to back|fund targeting",
    "projection": "projected|projects|expects to reach|expected to reach|aims to reach|targeting|forecast|on track to|hopes to|by 2027|by 2028|by 2030|plans to hit|guidance",
    "debt": "debt financing|venture debt|credit facility|loan|debt round|credit line",
    "grant": "grant|subsidy|prize|non-dilutive|innovate uk award|award from|scheme",
    "arr": "arr|annual recurring revenue|recurring revenue|run rate|run-rate",
    "revenue": "revenue|revenues|turnover|topline|top line|sales of|in sales|gross merchandise|billings|chiffre d'affaires|facturación|facturacion|ingresos de|umsatz|jahresumsatz|faturamento|receita de|fatturato|omzet|omsättning|przychody|ciro|pendapatan|doanh thu",
    "funding_raised": "raised|raises|raising|secured|secures|closed|closes|bagged|bags|nets|netted|funding round|seed round|pre-seed|series a|series b|investment round|led by|co-led by|participation from|backed by|financing round|capital injection|infusion|levée de fonds|ronda de|funding of|in funding|investment of|round of funding|oversubscribed"
    "|finanzierungsrunde|sammelte|eingesammelt|erhielt|seed-runde|investition von|levee de fonds|lève|leve|a levé|a leve|tour de table|financement de|ronda de financiación|ronda de financiacion|ha recaudado|recauda|levantó|levanto|capta|ha captado|ronda semilla"
    "|levantou|captou|rodada de|aporte de|rodada seed|ha raccolto|raccolto|round di finanziamento|aumento di capitale|haalde op|opgehaald|investeringsronde|tog in|hentet|reiste|rahoituskierros|finansieringsrunde|pozyskała|pozyskala|pozyskał|runda finansowania"
    "|yatırım aldı|yatirim aldi|yatırım turu|mengumpulkan|pendanaan|meraih pendanaan|kutipan dana|huy động|gọi vốn|جولة تمويل|تمويل بقيمة",
}
CUMULATIVE_PHRASES = listed("total funding|total raised|raised a total|brings its total|brings total|to date|cumulative|overall funding|since inception|all-time", "|")
QUALIFYING_TYPES = ["funding_raised", "revenue", "arr"]

# ---- hosts ---------------------------------------------------------------------------------------------------------
# Hosts by standing. A host counts with all its subdomains.
REGISTRY_HOSTS = listed("""
    find-and-update.company-information.service.gov.uk companieshouse.gov.uk mca.gov.in opencorporates.com
    handelsregister.de kvk.nl societe.com infogreffe.fr bizfile.gov.sg acra.gov.sg sec.gov asic.gov.au brreg.no
    bolagsverket.se virk.dk""")
PRESS_HOSTS = listed("""
    techcrunch.com venturebeat.com forbes.com bloomberg.com reuters.com ft.com wsj.com cnbc.com businessinsider.com
    theguardian.com bbc.com economictimes.indiatimes.com livemint.com business-standard.com thehindu.com yourstory.com
    inc42.com entrackr.com moneycontrol.com vccircle.com tech.eu sifted.eu eu-startups.com siliconcanals.com
    techcabal.com disrupt-africa.com disruptafrica.com wamda.com techinasia.com e27.co dealstreetasia.com
    startupdaily.net betakit.com maddyness.com gruenderszene.de frenchweb.fr startupticker.ch uktech.news
    silicon.co.uk arabnews.com zawya.com thenationalnews.com businessdailyafrica.com itweb.co.za contxto.com
    labsnews.com startupdaily.com.au theregister.com zdnet.com wired.com thesaasnews.com startuptalky.com
    beststartup.in startuprise.co.uk arabianbusiness.com finsmes.com techfundingnews.com nairametrics.com
    techpoint.africa technext24.com benjamindada.com weetracker.com techzim.co.zw itweb.africa
    startupsmagazine.co.uk technode.global technode.com vir.com.vn digitalnewsasia.com dailysocial.id techinafrica.com
    launchbaseafrica.com khusoko.com ffnews.com fintech.global menabytes.com magnitt.com calcalistech.com
    geektime.co.il globes.co.il ctech.co.il kr-asia.com 36kr.com nikkei.com thejakartapost.com bangkokpost.com
    vietnamnews.vn theedgemalaysia.com philstar.com dawn.com profit.pakistantoday.com.pk thedailystar.net bdnews24.com
    webrazzi.com startupsmagazine.eu trendingtopics.eu netokracija.com itkeymedia.com themayor.eu novobrief.com
    businesspost.ie irishtechnews.ie siliconrepublic.com startupsmagazine.com tech.co techerati.com uktn.co.uk
    eustartups.com startupbrett.com swissinfo.ch latamlist.com startupi.com.br neofeed.com.br bloomberglinea.com
    techpoint.ng condiaonline.com bigtechthisweek.com techafricanews.com innovation-village.com techloy.com
    thefintechtimes.com finextra.com altfi.com prnewswire.com businesswire.com globenewswire.com einpresswire.com""")
AGGREGATOR_HOSTS = listed("""
    crunchbase.com pitchbook.com tracxn.com dealroom.co cbinsights.com owler.com zoominfo.com growjo.com latka.com
    startupranking.com f6s.com angel.co wellfound.com magnitt.com startuplanes.com eu-startups.com seedtable.com
    failory.com startupblink.com""")
SOCIAL_HOSTS = listed("""
    linkedin.com twitter.com x.com facebook.com instagram.com youtube.com medium.com substack.com github.com
    producthunt.com about.me wikipedia.org""")
# Hosts that are never a company's own. A host counts with all its subdomains.
NO_COMPANY_HOSTS = listed("""
    techcrunch.com venturebeat.com forbes.com bloomberg.com reuters.com businessinsider.com wsj.com ft.com cnbc.com
    theguardian.com bbc.com economictimes.indiatimes.com indiatimes.com livemint.com business-standard.com yourstory.com
    inc42.com entrackr.com moneycontrol.com thehindu.com tech.eu sifted.eu eu-startups.com siliconcanals.com
    techcabal.com disrupt-africa.com wamda.com magnitt.com techinasia.com e27.co dealstreetasia.com startupdaily.net
    betakit.com maddyness.com gruenderszene.de frenchweb.fr startupticker.ch silicon.co.uk uktech.news arabnews.com
    zawya.com thenationalnews.com prnewswire.com businesswire.com globenewswire.com einpresswire.com medium.com
    substack.com crunchbase.com pitchbook.com tracxn.com dealroom.co cbinsights.com owler.com zoominfo.com apollo.io
    rocketreach.co signalhire.com linkedin.com twitter.com x.com facebook.com instagram.com youtube.com github.com
    wikipedia.org reddit.com quora.com glassdoor.com indeed.com producthunt.com g2.com capterra.com trustpilot.com
    angel.co wellfound.com google.com bing.com duckduckgo.com yahoo.com amazon.com apple.com microsoft.com notion.so
    wordpress.com blogspot.com wixsite.com eventbrite.com meetup.com slideshare.net scribd.com issuu.com contactout.com
    datanyze.com ceoemail.com bouncewatch.com muckrack.com ambitionbox.com craft.co ziprecruiter.com whitepages.com
    lusha.com clearbit.com hunter.io snov.io findthatlead.com parsers.vc clutch.co fi.co vestbee.com shizune.co
    investorhunt.co vcbacked.co openvc.app failory.com startupgenome.com growthlist.co coresight.com dxbstart.com
    demium.com seedtable.com startupblink.com theventurecodex.com startuplanes.com smbpodcast.com app.dealroom.co
    impactalpha.com retail-insider.com theglobeandmail.com arabnews.pk securitysystemsnews.com pulse2.com dokumen.pub
    lexology.com""")
# Parts of publications' names.
PRESS_MARKERS = listed(
    "news tech startup startups times herald tribune post daily weekly wire press media journal gazette report insider"
    " magazine bizz business ventures venturebeat digital crunch founders entrepreneur inno disrupt"
)
# Labels of public and academic bodies.
INSTITUTION_LABELS = listed("gov edu ac mil int sch k12 police nhs")
SECOND_LEVEL = listed("co com net org gov edu ac or ne in")
AUTHORITY_RANK = {"company_owned": 5, "official_registry": 5, "tier1_press": 4, "aggregator": 3, "social_profile": 2, "search_snippet": 1, "unknown": 0}
# File endings that are never fetched as pages.
SKIPPED_ENDINGS = r"\.(pdf|zip|docx?|xlsx?|pptx?|png|jpe?g|gif|svg|webp|mp4|mp3|css|js|ico)(\?|$)"
# Path segments and labels of the pages worth reading, by intent and in order of intent.
PAGE_INTENTS = {
    "about": listed("about about-us aboutus company who-we-are our-story ueber-uns a-propos quienes-somos"),
    "team": listed("team our-team leadership management founders people equipo equipe"),
    "contact": listed("contact contact-us contactus get-in-touch kontakt contacto contatti contato nous-contacter imprint impressum legal-notice mentions-legales aviso-legal colofon legal"),
    "careers": listed("careers career jobs join-us work-with-us vacancies hiring openings"),
    "product": listed("product products platform solutions features how-it-works technology pricing"),
    "press": listed("press news media newsroom blog/press announcements"),
    "locations": listed("locations offices where-we-are global"),
}

# ---- e-mail --------------------------------------------------------------------------------------------------------
# Endings of domains that addresses may have.
TLDS = listed("""
    com net org io co ai app dev tech xyz me info biz cloud digital studio agency solutions systems software online site
    space world life live media news group team work email global ventures capital fund finance health care eco edu gov
    ac int mil inc llc ltd gmbh company store shop in uk de fr es it nl be ch at se no dk fi ie pt pl cz sk hu ro bg gr
    tr ru ua by lt lv ee ca mx br ar cl au nz sg my id th vn ph hk tw jp kr cn ae sa qa kw bh om il eg ma ng ke za gh tz
    ug rw pk bd lk np ir iq jo lb is lu mt cy si hr rs ba mk al md ge am az kz uz mn kh la mm bn fj pg pe uy py bo ec ve
    cr pa gt hn sv ni do cu jm tt bb bs eu asia africa""")
# Mailboxes of desks rather than of persons.
ROLE_LOCAL_PARTS = listed("""
    info hello contact support sales admin team help office enquiries enquiry inquiry inquiries press media marketing
    careers jobs hr recruitment billing accounts finance legal privacy security abuse postmaster webmaster noreply
    no-reply donotreply newsletter partnerships partner bd business general mail email service customercare care feedback
    invest investors management board directors exec executive kontakt kontakta contacto contatti contato contacta
    presse impressum bonjour hola ciao salut hallo info-de anfrage buchhaltung vertrieb contactus getintouch sayhello hi
    hey welcome reception hellothere letstalk talktous newbusiness new-business pr comms communications ops operations
    it dev devs staff people talent hiring recruiting apply jobs2 ir events community orders order accounting accounts2
    all everyone everybody group company main reach""")
OFFICER_LOCAL_PARTS = listed(
    "ceo founder founders cofounder co-founder founder1 md managingdirector gf geschaeftsfuehrung geschäftsführung"
    " direccion direction gerencia amministratore"
)
DISPOSABLE_DOMAINS = listed("""
    mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org throwawaymail.com yopmail.com
    trashmail.com sharklasers.com getnada.com maildrop.cc dispostable.com fakeinbox.com mailnesia.com spamgourmet.com
    mohmal.com emailondeck.com tempr.email discard.email mintemail.com""")
FREEMAIL_DOMAINS = listed("""
    gmail.com googlemail.com yahoo.com yahoo.co.uk yahoo.co.in hotmail.com outlook.com live.com msn.com aol.com
    icloud.com me.com mail.com protonmail.com proton.me gmx.com gmx.de yandex.com yandex.ru zoho.com rediffmail.com
    qq.com 163.com 126.com naver.com""")
# Words before "at" that make it prose.
PROSE_WORDS = listed(
    "more us me here this it them him her you founder ceo team story work available reach look now today online live free"
    " back out in on up down again soon later everything anything something all both one two office offices home shop"
    " store site website page blog news based"
)
EMAIL_STATUS_RANK = {"invalid": 0, "not_found": 1, "role_only": 2, "found_unverified": 3, "source_verified": 4, "verified": 5}

# ---- names ---------------------------------------------------------------------------------------------------------
# Forms of companies at the end of a name.
LEGAL_SUFFIXES = listed(
    "inc llc lllp llp ltd limited pvt private plc gmbh ug bv nv sa sas sarl ab as oy oyj aps srl spa sl pte sdn bhd kk ao"
    " pjsc fzc fze dmcc co corp corporation company incorporated holdings holding the"
)
# Words of jobs and of form labels, which are no persons' names.
ROLE_WORDS = listed("""
    founder founders cofounder co-founder founding ceo cto coo cfo cmo cpo cio cro chief president vice vp director
    directors head officer partner partners investor investors chairman chairwoman chair owner executive manager lead
    principal ex former serial angel mentor advisor adviser alum alumni entrepreneur entrepreneurs expert veteran employee
    employees member members guest speaker""")
LABEL_WORDS = listed("""
    personal email e mail e-mail emails phone telephone telefon tel fax mobile address adresse anschrift contact kontakt
    website web site registered register registration registergericht court tax vat ust steuernummer handelsregister
    company firm office headquarters hq postal post street strasse city country zip postcode details information info
    imprint impressum colofon responsible verantwortlich disclaimer privacy cookies general enquiries support sales press
    media careers number name title role position department""")
NAME_STOP_WORDS = listed("""
    said says the a an and or will was were is are has have had this that our their its we they he she funding round
    company startup platform million today also new more about with from for after before who which leadership team
    management board people founders staff meet executives directors advisors contact""")
# Verbs of funding headlines.
HEADLINE_VERBS = (
    r"raises?|raised|raising|secures?|secured|closes?|closed|bags?|bagged|nets?|netted|lands?|landed|announces?|announced"
    r"|picks up|scores?|scored|gets?|receives?|received|obtains?|attracts?|attracted|snags?|snagged|pulls in|banks?"
    r"|rakes in|clinches?|completes?|completed|wraps up|adds?|draws?"
)
# Words that describe a company but make no part of its name.
DESCRIPTORS = listed("""
    fintech healthtech healthcare edtech insurtech proptech agritech foodtech cleantech climatetech deeptech medtech
    regtech legaltech traveltech adtech hrtech martech retailtech logistics mobility cybersecurity security biotech
    spacetech startup startups scaleup scale-up company firm business platform venture unicorn soonicorn provider maker
    player giant leader innovator operator developer app software saas ai b2b b2c tech technology digital online mobile
    cloud data crypto web3 gaming ecommerce e-commerce exclusive breaking update report opinion analysis profile interview
    just now again also meet watch why how what new the a an this that its it and or with for from after before""")

# Forms of companies that are left out of a name as it is written.
FORM_WORDS = listed("inc llc ltd limited pvt private plc gmbh bv nv sa sas sarl ab as oy aps srl spa pte sdn bhd")
# Words that are no name by themselves.
WEAK_NAME_WORDS = listed("""
    the a an this that these those it its we our us startup startups company companies firm platform founder founders ceo
    news report top best list why how what new more million funding round seed series investors investment raises raised
    secures closes announces launches today year month""")
FILLER_WORDS = listed("now here today free more all us our the a an your my new out up in to for best top leading list guide of and")
LINKING_WORDS = listed("and or with from after before during into about")
PLACE_WORDS = listed("city region province state county district")
# Trades, publishers, buttons and sections of sites, which are no company's name.
GENERIC_NAMES = listed("""
    fintech|healthtech|edtech|insurtech|proptech|agritech|foodtech|cleantech|climatetech|deeptech|medtech|regtech|legaltech
    |traveltech|adtech|hrtech|martech|retailtech|biotech|spacetech|cybersecurity|saas|software|technology|tech|startup
    |startups|venture|ventures|capital|partners|holdings|group|labs|digital|innovation|ecosystem|accelerator|incubator
    |portfolio|investors|investor|funding|fund|funds|seed|angel|angels|equity|advisors|advisory|consulting|openvc|failory
    |shizune|investorhunt|vcbacked|crunchbase|dealroom|tracxn|pitchbook|eif|ebrd|eib|mexicobusiness|businessnews
    |techcrunch|sifted|eustartups|siliconcanals|wamda|magnitt|f6s|linkedin|medium|substack|wikipedia|producthunt
    |rocketreach|signalhire|zoominfo|apollo|lusha|clearbit|owler|growjo|join|apply|login|log in|signin|sign in|signup
    |sign up|register|subscribe|newsletter|download|demo|pricing|docs|documentation|support|help|faq|contact|about|home
    |blog|news|press|careers|jobs|privacy|terms|cookies|imprint|impressum|legal|back|next|previous|more|view|see|read
    |learn|explore|discover|get|start|menu|search|share|follow|connect|team|people|events|resources|insights|community
    |members|apply now|read more|learn more|view all|see all|get started|find out more|our team|our story|who we are
    |sponsor|sponsors|sponsor us|sponsorship|advertise|advertising|donate|shop|store|merch|gallery|photos|videos|podcasts
    |webinars|reports|report|directory|database|awards|summit|conference|conferences|programs|programmes|program|programme
    |services|solutions|companies|archive|sitemap|rss|feedback|volunteer|membership|partnerships|consultancy|consultancies
    |newsletters|magazines|interviews|opinion|editorial|guides""", "|")
# Phrases of pages that list companies, and of those that list investors.
HUB_HINTS = listed("portfolio|our companies|cohort|batch|alumni|startups to watch|top 10|top 20|top 50|member companies|finalists|showcase|accelerator|incubator|our investments|companies we", "|")
INVESTOR_HINTS = listed("""
    list of investors|investor directory|vc firms|venture capital firms|top investors|angel investors|find investors
    |investor list|fundraising tools|investor database|lead investors|family offices|funds investing|active investors
    |investor crm|raise capital|pitch investors|investors in|vcs investing|seed funds in""", "|")

# ---- places --------------------------------------------------------------------------------------------------------
# The United States by name, state and city.
US_NAMES = listed("united states|united states of america|usa|u.s.a.|u.s.|us|america", "|")
US_STATES = listed("""
    alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana
    |iowa|kansas|kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska
    |nevada|new hampshire|new jersey|new mexico|new york|north carolina|north dakota|ohio|oklahoma|oregon|pennsylvania
    |rhode island|south carolina|south dakota|tennessee|texas|utah|vermont|virginia|washington|west virginia|wisconsin
    |wyoming|district of columbia""", "|")  # fmt: skip
US_CITIES = listed("""
    new york|san francisco|los angeles|chicago|boston|seattle|austin|denver|miami|atlanta|dallas|houston|san diego
    |philadelphia|phoenix|san jose|palo alto|mountain view|menlo park|santa monica|brooklyn|washington dc|silicon valley
    |bay area|nyc|sf""", "|")  # fmt: skip
# What companies put before their name where the bare domain was taken, and what placeholder pages say.
HOST_PREFIXES = listed("get try use join go my the app we hey with meet team")
PARKED_TELLS = listed("this domain is for sale|buy this domain|domain for sale|parked free|courtesy of godaddy|coming soon|under construction|website is currently unavailable|default web page|namecheap|sedo|index of /", "|")
# How lines begin that describe nothing, and words of lines that describe a company.
NO_DESCRIPTION = listed("cookie|we use cookies|privacy|terms|copyright|all rights reserved|skip to|menu|sign in|log in|subscribe|newsletter|loading", "|")
DESCRIBING_WORDS = listed("platform|software|app|solution|product|technology|builds|provides|helps|enables|offers|is a|we are|powers|delivers", "|")
# Countries whose companies register below a second-level domain.
SECOND_LEVEL_COUNTRY = pairs("""
    Kenya=co.ke, South Africa=co.za, Egypt=com.eg, Bangladesh=com.bd, Indonesia=co.id, Malaysia=com.my, Thailand=co.th, Australia=com.au, New Zealand=co.nz,
    Brazil=com.br, Argentina=com.ar, United Kingdom=co.uk, Turkey=com.tr, Israel=co.il, Saudi Arabia=com.sa""")
# A state that is also a country, and the signs beside it that mean the state.
AMBIGUOUS_STATES = ["georgia"]
US_SECOND_SIGNS = listed("usa atlanta savannah")
# Words beside "us" that make it a pronoun, and words beside it that make it the country.
US_PRONOUN_BEFORE = listed("""
    contact about join with email mail follow reach tell ask help let for to of near like give show call text meet trust
    choose hire support thank visit message write and why at by from between among all made""")
US_PRONOUN_AFTER = listed("""
    today now on at via here if a an and know directly anytime your you build grow help so what how why or for to with
    about improve understand""")
US_BEFORE = listed("the in across throughout")
US_AFTER = listed("""
    based market markets office offices customers clients headquarters hq subsidiary entity entities incorporated
    incorporation company corporation dollar dollars team operations expansion launch resident residents user users state
    states federal citizen citizens""")
# Words that say where a company is, and those of its seat.
LOCATING_CUES = listed("based|headquarters|headquartered|headquarter|head office|headoffice|hq|located|situated|registered|registered office|office in|offices in|our office|founded in|incorporated in|operating out of|address", "|")
SEAT_CUES = listed("headquartered|based|located|head office|registered office", "|")
# Countries of domain endings and of nationalities.
TLD_COUNTRY = pairs("""
    in=India, uk=United Kingdom, fr=France, de=Germany, es=Spain, it=Italy, nl=Netherlands, be=Belgium, ch=Switzerland,
    at=Austria, se=Sweden, no=Norway, dk=Denmark, fi=Finland, ie=Ireland, pt=Portugal, pl=Poland, cz=Czech Republic,
    sk=Slovakia, hu=Hungary, ro=Romania, bg=Bulgaria, gr=Greece, tr=Turkey, ua=Ukraine, ee=Estonia, lv=Latvia,
    lt=Lithuania, si=Slovenia, hr=Croatia, rs=Serbia, is=Iceland, lu=Luxembourg, mt=Malta, cy=Cyprus, ca=Canada,
    mx=Mexico, br=Brazil, ar=Argentina, cl=Chile, pe=Peru, uy=Uruguay, ec=Ecuador, au=Australia, nz=New Zealand,
    sg=Singapore, my=Malaysia, id=Indonesia, th=Thailand, vn=Vietnam, ph=Philippines, hk=Hong Kong, tw=Taiwan, jp=Japan,
    kr=South Korea, cn=China, ae=United Arab Emirates, sa=Saudi Arabia, qa=Qatar, kw=Kuwait, bh=Bahrain, om=Oman,
    il=Israel, jo=Jordan, lb=Lebanon, eg=Egypt, ma=Morocco, tn=Tunisia, ng=Nigeria, ke=Kenya, za=South Africa, gh=Ghana,
    tz=Tanzania, ug=Uganda, rw=Rwanda, pk=Pakistan, bd=Bangladesh, lk=Sri Lanka, np=Nepal""")
DEMONYM_COUNTRY = pairs("""
    indian=India, pakistani=Pakistan, bangladeshi=Bangladesh, sri lankan=Sri Lanka, nepali=Nepal,
    emirati=United Arab Emirates, saudi=Saudi Arabia, saudi arabian=Saudi Arabia, qatari=Qatar, kuwaiti=Kuwait,
    bahraini=Bahrain, omani=Oman, jordanian=Jordan, lebanese=Lebanon, israeli=Israel, turkish=Turkey,
    singaporean=Singapore, australian=Australia, canadian=Canada, japanese=Japan, chinese=China, korean=South Korea,
    south korean=South Korea, taiwanese=Taiwan, brazilian=Brazil, mexican=Mexico, chilean=Chile, colombian=Colombia,
    peruvian=Peru, argentine=Argentina, argentinian=Argentina, uruguayan=Uruguay, nigerian=Nigeria, kenyan=Kenya,
    south african=South Africa, ghanaian=Ghana, egyptian=Egypt, moroccan=Morocco, tunisian=Tunisia, ethiopian=Ethiopia,
    ugandan=Uganda, rwandan=Rwanda, tanzanian=Tanzania, senegalese=Senegal, swedish=Sweden, norwegian=Norway,
    danish=Denmark, finnish=Finland, polish=Poland, czech=Czech Republic, hungarian=Hungary, romanian=Romania,
    bulgarian=Bulgaria, ukrainian=Ukraine, estonian=Estonia, latvian=Latvia, lithuanian=Lithuania, slovak=Slovakia,
    slovenian=Slovenia, croatian=Croatia, serbian=Serbia, greek=Greece, swiss=Switzerland, austrian=Austria,
    belgian=Belgium, dutch=Netherlands, french=France, german=Germany, spanish=Spain, italian=Italy,
    portuguese=Portugal, irish=Ireland, british=United Kingdom, scottish=United Kingdom, welsh=United Kingdom,
    indonesian=Indonesia, malaysian=Malaysia, thai=Thailand, filipino=Philippines, philippine=Philippines,
    vietnamese=Vietnam, cambodian=Cambodia, burmese=Myanmar, new zealand=New Zealand, american=United States""")

# Cities by country.
CITIES = {
    "India": "bengaluru|bangalore|mumbai|delhi|new delhi|gurugram|gurgaon|noida|hyderabad|pune|chennai|kolkata|ahmedabad|jaipur|kochi|indore",
    "United Kingdom": "london|manchester|edinburgh|bristol|cambridge|oxford|leeds|glasgow|birmingham",
    "France": "paris|lyon|toulouse|marseille|bordeaux|nantes|lille",
    "Germany": "berlin|munich|münchen|hamburg|cologne|frankfurt|stuttgart",
    "Netherlands": "amsterdam|rotterdam|utrecht|eindhoven|the hague|delft",
    "Spain": "madrid|barcelona|valencia|seville", "Italy": "milan|rome|turin|bologna", "Portugal": "lisbon|porto", "Ireland": "dublin|cork",
    "Switzerland": "zurich|geneva|lausanne|basel", "Austria": "vienna|graz", "Belgium": "brussels|ghent|antwerp|leuven",
    "Sweden": "stockholm|gothenburg|malmo|malmö", "Denmark": "copenhagen|aarhus", "Norway": "oslo|bergen", "Finland": "helsinki|espoo|tampere",
    "Poland": "warsaw|krakow|kraków|wroclaw|gdansk", "Czech Republic": "prague|brno", "Hungary": "budapest", "Romania": "bucharest|cluj",
    "Bulgaria": "sofia", "Estonia": "tallinn", "Latvia": "riga", "Lithuania": "vilnius", "Slovenia": "ljubljana", "Croatia": "zagreb",
    "Serbia": "belgrade", "Greece": "athens|thessaloniki", "Turkey": "istanbul|ankara|izmir", "Ukraine": "kyiv|kiev|lviv",
    "United Arab Emirates": "dubai|abu dhabi|sharjah", "Saudi Arabia": "riyadh|jeddah", "Qatar": "doha", "Kuwait": "kuwait city", "Bahrain": "manama",
    "Oman": "muscat", "Jordan": "amman", "Lebanon": "beirut", "Israel": "tel aviv|jerusalem|haifa|herzliya", "Egypt": "cairo|alexandria",
    "Morocco": "casablanca|rabat", "Tunisia": "tunis", "Nigeria": "lagos|abuja", "Kenya": "nairobi",
    "South Africa": "cape town|johannesburg|pretoria|durban", "Ghana": "accra", "Uganda": "kampala", "Rwanda": "kigali", "Tanzania": "dar es salaam",
    "Pakistan": "karachi|lahore|islamabad", "Bangladesh": "dhaka", "Sri Lanka": "colombo", "Nepal": "kathmandu", "Singapore": "singapore",
    "Malaysia": "kuala lumpur|penang", "Indonesia": "jakarta|bandung|surabaya", "Thailand": "bangkok|chiang mai",
    "Vietnam": "hanoi|ho chi minh city|saigon|da nang", "Philippines": "manila|cebu", "Hong Kong": "hong kong", "Taiwan": "taipei",
    "Japan": "tokyo|osaka", "South Korea": "seoul|busan", "China": "shanghai|beijing|shenzhen|hangzhou",
    "Australia": "sydney|melbourne|brisbane|perth|adelaide|canberra", "New Zealand": "auckland|wellington|christchurch",
    "Canada": "toronto|vancouver|montreal|ottawa|calgary|waterloo", "Brazil": "sao paulo|são paulo|rio de janeiro|belo horizonte|florianopolis|curitiba",
    "Mexico": "mexico city|guadalajara|monterrey", "Colombia": "bogota|bogotá|medellin|medellín", "Chile": "santiago", "Argentina": "buenos aires",
    "Peru": "lima", "Uruguay": "montevideo", "Ecuador": "quito", "Costa Rica": "san jose costa rica", "Panama": "panama city",
}
CITY_COUNTRY = {city: country for country, cities in CITIES.items() for city in cities.split("|")}
COUNTRIES = sorted({*TLD_COUNTRY.values(), *DEMONYM_COUNTRY.values(), *CITIES})

# ---- companies -----------------------------------------------------------------------------------------------------
# Phrases of companies that are no operating company: one decides, the supporting ones add up.
DECISIVE_PHRASES = {
    "an investor": "we are a venture capital|we are an early-stage investor|we are an early stage investor|we are a seed fund|we are a fund|venture capital firm|venture capital fund|our portfolio companies|we invest in|we back founders|we lead rounds|we write cheques|we write checks|limited partners|assets under management|our investment thesis|we are an investor|apply to our program|apply to our programme|our accelerator|our cohort",
    "a publication": "our journalists|our reporters|editorial team|advertise with us|press releases submitted|submit a press release|media kit|our newsroom team|letters to the editor|editorial guidelines",
    "an agency or consultancy": "we are an agency|we are a consultancy|our consultants|pitch deck design|fundraising consultancy",
    "a workspace or community": "coworking space|co-working space|shared office space|startup hub|community hub|members club|members' club|event space|book a desk|book a tour|hot desk|hot desks|meeting rooms available|our members|membership plans|join our community of founders",
}
SUPPORTING_PHRASES = {
    "an investor": "portfolio companies|seed fund|family office|private equity firm|angel syndicate|we back|our investments|early-stage investor|accelerator program|accelerator programme|backing founders|we partner with founders|venture fund",
    "a publication": "newsroom|breaking news|latest news and analysis|media outlet|magazine|podcast episode|market research reports|industry analysis reports|research and advisory firm",
    "an agency or consultancy": "our clients|consulting services|we help companies build|advisory services for|client engagements|our agency",
}
PRODUCT_SIGNALS = listed("start free trial|start your free trial|free trial|book a demo|request a demo|get a demo|our platform|the platform|api documentation|developer docs|integrations|pricing plans|per month|sign up free|create an account|our product|product tour|customer support|uptime|sdk|dashboard", "|")
PLATFORM_TERMS = listed("platform|software|saas|web app|mobile app|api|apis|dashboard|marketplace|machine learning|artificial intelligence|algorithm|algorithms|automation|cloud-based|our app|the app|our product|our platform|integrations|sdk|open source|self-serve|no-code|low-code|data platform|analytics platform|software platform|technology platform|operating system|infrastructure for|built on", "|")
SERVICES_TERMS = listed("consultancy|consulting firm|staffing agency|recruitment agency|law firm|advisory firm|marketing agency|design agency|outsourcing services|bespoke development services|it services company|system integrator", "|")
# Keywords of sectors, in the order that settles ties.
SECTOR_KEYWORDS = {
    "Healthtech / Digital health": "digital health|healthcare|health tech|patient|clinic|telemedicine|care coordination|medical|ehr|hospital",
    "Edtech": "edtech|learning platform|students|curriculum|upskilling|workforce development|courses|training platform",
    "Cybersecurity": "cybersecurity|threat detection|vulnerability|security posture|penetration testing|soc |zero trust|endpoint security",
    "Fintech / Payments": "fintech|payments|wallet|lending|credit|banking|embedded finance|payouts|remittance|settlement",
    "Insurtech": "insurtech|insurance|underwriting|claims processing",
    "Digital twin / Industrial": "digital twin|simulation|industrial iot|factory|manufacturing|predictive maintenance",
    "Traveltech": "travel|booking platform|itinerary|airline|hotel|tourism",
    "Logistics / Supply chain": "logistics|supply chain|freight|shipment|warehouse|last mile|fleet",
    "Agritech": "agritech|agriculture|farmers|crop|farm management",
    "HR tech": "recruitment|hiring platform|hr platform|payroll|talent platform|applicant tracking",
    "Proptech / Construction": "proptech|real estate|construction|property management",
    "Climate / Energy": "climate|carbon|renewable|energy management|sustainability|emissions",
    "Legaltech": "legaltech|contract management|compliance automation|legal teams",
    "Retail / Commerce": "ecommerce|e-commerce|retail|merchants|storefront|point of sale|commerce platform",
    "AI / Machine learning": "artificial intelligence|machine learning|ai platform|ai agents|llm|computer vision|nlp",
    "B2B SaaS": "b2b saas|saas platform|enterprise software|business software|workflow automation|api platform",
}
PRODUCT_PATHS = listed("/product /platform /features /pricing /solutions /docs /api /how-it-works /technology")
INVESTOR_TLDS = listed(".vc .fund .capital .ventures")
INVESTOR_WORDS = listed("ventures venturepartners capitalpartners seedfund venturefund growthfund angelfund")
PUBLICATION_LABELS = listed("insider magazine journal gazette herald tribune times newsroom reporter weekly -news news- thenews dailynews presse")
# Weights of sectors and of countries in the fit score.
FIT_SECTORS = pairs("""
    healthcare=1.0, health=1.0, healthtech=1.0, digital health=1.0, medtech=0.9, education=1.0, edtech=1.0,
    workforce=0.9, learning=0.9, ai=1.0, artificial intelligence=1.0, machine learning=0.95, automation=0.9,
    cybersecurity=1.0, security=0.9, compliance=0.85, digital twin=1.0, simulation=0.9, iot=0.85, fintech=1.0,
    payments=1.0, embedded finance=1.0, lending=0.9, insurtech=0.85, travel=1.0, traveltech=1.0, mobility=0.8,
    saas=0.95, b2b=0.9, b2b2c=0.9, enterprise software=0.9, marketplace=0.8""")
HUB_COUNTRIES = pairs("""
    United Kingdom=1.0, France=1.0, India=1.0, United Arab Emirates=1.0, Singapore=0.9, Pakistan=0.85, Germany=0.8,
    Netherlands=0.8, Spain=0.75, Ireland=0.75, Switzerland=0.75, Sweden=0.75, Denmark=0.7, Norway=0.7, Finland=0.7,
    Poland=0.7, Brazil=0.8, Mexico=0.8, Colombia=0.75, Chile=0.7, Argentina=0.7, Nigeria=0.8, Kenya=0.8,
    South Africa=0.75, Egypt=0.7, Indonesia=0.75, Vietnam=0.75, Malaysia=0.7, Philippines=0.7, Thailand=0.7,
    Bangladesh=0.7, Sri Lanka=0.65, Turkey=0.7, Israel=0.7, Australia=0.6, New Zealand=0.55, Canada=0.55, Japan=0.5,
    South Korea=0.5""")

# ---- planning ------------------------------------------------------------------------------------------------------
# The five dimensions of the search space, and what a cell's shape and market are worth.
SECTORS = listed("healthtech edtech ai cybersecurity digital_twin fintech traveltech b2b_saas b2b2c proptech logistics agritech hrtech insurtech climatetech legaltech retailtech")
GEOGRAPHIES = listed("""
    india uk france uae saudi singapore germany netherlands spain italy nordics cee iberia_pt ireland switzerland brazil
    mexico latam_other nigeria kenya south_africa egypt indonesia vietnam malaysia thailand philippines pakistan
    bangladesh turkey israel australia newzealand canada japan korea""")
PHRASINGS = listed("seed_usd preseries_a generic_round inr eur other_ccy revenue investor_led")
ROLLING_WINDOWS = ["this week", "past 7 days", "this month", "last month"]
FIXED_WINDOWS = ["2026", "2026 Q2", "2026 Q1", "2025 H2", "2025", "last 12 months"]
SHAPES = listed("in_band_amount funding_roundup funding_news funding_tracker accelerator_cohort vc_portfolio startup_directory company_site award_list")
SHAPE_BONUS = {"in_band_amount": 0.50, "funding_tracker": 0.45, "funding_news": 0.35, "funding_roundup": 0.30, "accelerator_cohort": 0.10, "award_list": 0.05, "startup_directory": -0.10, "company_site": 0.0, "vc_portfolio": -0.20}

# ---- gates ---------------------------------------------------------------------------------------------------------
# Gates in their order, kinds of US signals that weigh alone, and kinds of candidates by rank.
GATES = ["funding_or_revenue", "technology_platform", "us_presence", "founder_identified", "email_verified"]
HARD_US_SIGNALS = listed("hq_in_us us_office us_subsidiary us_incorporation us_job_posting")
WEAK_US_SIGNALS = listed("us_phone us_address_mention us_locale_page us_press_dateline")
SOURCE_KIND_RANK = {"headline": 0, "company_site": 1, "article": 2, "link_hub": 3, "unknown": 4}
