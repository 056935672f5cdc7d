"""A small labelled url table for the url classifier: invented addresses of pages one would block, and of pages one would keep."""

BLOCK = """
http://free-casino-bonus.example/spin/now
http://www.casino777-online.example/slots/jackpot
https://best-poker-bonus.example/play/free-spins
https://luckyslots.example/casino/bonus
http://bet365-win.example/sportsbet/odds
https://betting-tips-win.example/bet/today
http://online-gambling-win.example/roulette/bonus
http://xxx-girls-cam.example/live/sex
https://sexcam-live.example/girls/xxx
http://hot-adult-dating.example/sex/chat
https://adult-xxx-video.example/porn/free
http://freeporn-tube.example/video/xxx
https://nude-cam-chat.example/adult/live
http://buy-cheap-viagra.example/pills/order
https://cheap-pills-online.example/viagra/buy
http://rx-pharmacy-discount.example/buy/cialis
https://discount-meds-pharmacy.example/pills/cheap
http://weight-loss-miracle.example/diet/pills/buy
https://replica-watches-cheap.example/buy/rolex
http://cheap-replica-bags.example/sale/discount
https://crack-keygen-download.example/serial/free
http://warez-download-free.example/crack/keygen
https://free-movie-torrent.example/download/full
http://torrent-crack.example/download/keygen
http://download-free-codec.example/install/setup.exe
https://flash-update-now.example/install/player.exe
http://secure-login-verify.example/account/update
https://account-verify-login.example/bank/confirm
http://paypa1-login.example/verify/account
https://bank-secure-update.example/login/confirm
http://win-free-iphone.example/prize/claim
https://claim-your-prize.example/winner/gift
http://free-gift-card.example/claim/winner
https://survey-reward-win.example/prize/free
http://make-money-fast.example/earn/home
https://earn-cash-online.example/money/fast
http://payday-loan-instant.example/cash/apply
https://instant-cash-loans.example/payday/fast
http://forex-profit-bot.example/earn/money
https://crypto-double-profit.example/earn/bitcoin
http://bitcoin-doubler.example/invest/profit
https://click-ads-track.example/adserver/redirect
http://adserver-banner.example/ads/click
https://popup-ads.example/click/track/redirect
http://track-click.example/redirect/ads/banner
https://cheap-essay-buy.example/order/now
http://buy-followers-cheap.example/likes/order
https://cheap-likes-buy.example/followers/now
http://seo-backlinks-cheap.example/buy/links
https://link-farm-seo.example/backlinks/buy
http://singles-dating-hot.example/chat/girls
https://meet-hot-singles.example/dating/chat
http://psychic-love-spell.example/buy/reading
https://casino-poker-slots.example/bonus/play
http://free-spins-win.example/slots/casino
https://viagra-cialis-rx.example/order/pills
""".split()

ALLOW = """
https://www.city-library.example/catalogue/books/river
http://museum-of-history.example/collection/objects/12
https://university.example/research/papers/climate
https://news.valley-post.example/2019/05/council-vote
http://weather-service.example/forecast/region/north
https://docs.python-guide.example/tutorial/lists
https://en.encyclopedia.example/wiki/Photosynthesis
http://gardening-notes.example/articles/tomatoes
https://cooking-school.example/recipes/bread
https://blog.mountain-walks.example/2020/summer-hike
http://parliament.example/records/session/41
https://court-archive.example/decisions/2011/civil
http://school-district.example/calendar/term
https://journal-of-geology.example/articles/volume-12
http://bird-watch.example/species/heron
https://railway-society.example/history/stations
https://health-ministry.example/guidelines/vaccination
http://hospital.example/departments/cardiology
https://open-data.example/datasets/rainfall
https://statistics-office.example/tables/population
http://local-history.example/articles/old-bridge
https://theatre.example/programme/autumn
https://orchestra.example/concerts/season
http://farmers-market.example/about/hours
https://science-magazine.example/news/telescope
https://forum.woodwork.example/thread/joints
http://chess-club.example/games/annotated
https://poetry-archive.example/poems/winter
https://language-school.example/grammar/verbs
http://travel-notes.example/places/harbour
https://fire-brigade.example/safety/advice
http://water-board.example/reports/quality
https://river-trust.example/projects/restoration
http://botanical-garden.example/plants/ferns
https://astronomy-club.example/observations/comet
https://bakery.example/about/opening-hours
http://cycling-club.example/routes/valley
https://software-manual.example/docs/install/linux
https://api-reference.example/docs/functions/index
http://mathematics.example/lectures/algebra
https://law-review.example/articles/contracts
http://engineering-notes.example/bridges/steel
https://philosophy.example/essays/ethics
https://news.harbour-times.example/2021/03/ferry
http://archive.radio.example/programmes/interview
https://public-health.example/reports/annual
http://family-history.example/records/census
https://geography.example/maps/islands
https://national-park.example/trails/map
http://beekeeping.example/guide/spring
https://choir.example/repertoire/songs
https://swimming-club.example/training/times
http://town-hall.example/services/permits
https://observatory.example/data/stars
https://economics.example/working-papers/trade
http://novel-reviews.example/reviews/2018
""".split()
