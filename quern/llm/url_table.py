"""Hosts labelled by hand, which the default table of the URL filter has beside those that it makes by rule."""

#: hosts of public bodies, schools, papers, shops, clubs and small sites, many with pieces that unwanted hosts have too
WANTED = """
wikipedia.org arxiv.org archive.org gutenberg.org openstreetmap.org python.org apache.org kernel.org debian.org gnu.org w3.org ietf.org iso.org unesco.org un.org imf.org europa.eu
parliament.uk bundestag.de gouv.fr nasa.gov noaa.gov usgs.gov loc.gov nih.gov census.gov cern.ch esa.int mit.edu stanford.edu ox.ac.uk ethz.ch uni-heidelberg.de sorbonne.fr unam.mx
springer.com nature.com plos.org jstor.org bmj.com lancet.com cambridge.org britannica.com merriam-webster.com duden.de larousse.fr rae.es
bbc.co.uk lemonde.fr spiegel.de elpais.com guardian.co.uk nytimes.com reuters.com apnews.com euronews.com localherald.com
github.io gitlab.com stackoverflow.com sourceforge.net readthedocs.io pypi.org maven.org docs.rs
weather.com meteofrance.fr dwd.de yr.no allrecipes.com marmiton.org chefkoch.de bakingathome.net imdb.com discogs.com goodreads.com lonelyplanet.com tripadvisor.com
essexcountylibrary.org sussexgardens.co.uk middlesexcricket.org adultliteracy.org adultswimclub.net betterbuildings.org alphabetsoup.net betatesting.io bethlehemcollege.edu diabetes.org
slotcarracing.org timeslots.net jackpotatoes.co.uk winemakers.org winterthur.ch windsurfing.org darwinproject.ac.uk freecyclegroup.org freelancers.net liberty-museum.org clickandcollect.co.uk
trackworkers.org railtracks.net racetrackhistory.org nudgepolicy.org scunthorpe-online.co.uk cockburnlibrary.org analystsforum.net therapistfinder.org expertsexchange.net penisland-ferry.org
pokerfacetheatre.org bingleyhall.co.uk gamblegardens.org oddfellows.co.uk loanlibrary.org paydayvolunteers.org pillowtalk-quilts.com replicaships.net cheapsidehotel.co.uk virusmuseum.org
camdenmarket.co.uk webcam-volcano.org datingfossils.org escortmission-games.net spamcookbook.net crackingeggs.com keygenealogy.org torrentriver.org bonusmalus-law.de prizewinningroses.com
""".split()
#: invented hosts of the unwanted kinds, as such hosts are commonly spelled
UNWANTED = """
luckyspin-casino.com royalvegasslots.net mega-jackpot777.com bet365x-bonus.net betkings24.com livebetting-odds.info sportsbet-win.biz pokerstarz-free.net onlinepokerroom.xyz roulette-royale.club bingoparty-win.com
scratch-lottery-winner.net slots4money.com topcasinobonus.org casinogratis24.es spielcasino-bonus.de casinos-en-ligne.biz apuestas-ganador.net freespins-now.com gamblersparadise.xyz
cheap-viagra-pills.com buy-cialis-online.net canadianpharmacy-rx.biz noprescription-meds.com weightloss-pills24.net dietpillsdirect.xyz ed-pills-shop.com pharma-discount-meds.info
xxxtube.xyz freeporn-videos.net hotsexcams.com adultcam-live.net nude-teens-pics.xyz sexdating-now.com milf-hookup.net escortgirls24.biz pornohub-gratis.net livesex-chat.club xxx-movies-hd.com adultfriends-dating.net
fastpayday-loans.com easycash-loan.biz badcredit-loans24.net quickloans-approved.xyz forex-profit-robot.com getrichfast-crypto.net bitcoin-doubler.biz binary-options-win.com earn-money-home.xyz
replica-watches-cheap.com fake-rolex-store.net cheapjerseys-wholesale.biz luxury-handbags-replica.xyz discount-outlet-bags.net
warez-download.net cracked-software.xyz keygen-serials.com freetorrents-hd.net torrentz-mirror.xyz crackserialkey.info nulled-scripts.net fullmovie-download-free.xyz
click-track-ads.com adserver-network.net popunder-traffic.com banner-exchange-ads.biz trackpixel-stats.net affiliate-clicks.xyz adsyndication-serve.com trafficboost-hits.net
free-iphone-prize.xyz you-won-giftcard.com claimyourprize-now.net survey-rewards-free.biz account-verify-login.xyz secure-bank-update.info paypa1-signin.net virus-alert-fix.com pc-cleaner-malware.net spamblaster-mail.biz
seo-linkfarm.biz buy-backlinks-cheap.net essay-writing-cheap.com doorway-pages.xyz clickbait-daily.info
""".split()
