"""Texts of a documents table, read and labelled one by one: (1, text) is no prose, (0, text) is prose.

None of them is fitted or calibrated on.
"""

TEXTS = (
    (0, '@ottin\n\nLast spring, each alert skips this compact tunnel.'),
    (0, 'Le fragment petit vérifie le moteur discret après le troisième essai.'),
    (0, 'The vivid probe releases another footer during a slow afternoon.'),
    (0, 'Expected behaviour:\nla requête étrange sépare le jardin simple pendant plusieurs semaines la fiche dutodruvo raccourcit la tâche discrète pendant plusieurs semaines le plus souvent, la branche petite remplace la requête récente.'),
    (0, 'The legal sawmill locates another varint after the third retry.'),
    (0, 'project kotizisi combines our warm ferry against every estimate.'),
    (0, 'Behind the scenes, this secret scorer strains the curious pavement.'),
    (0, 'In 223 of 269 runs, the needle revisits a ceiling.'),
    (1, 'lyoKxVwX3BSoIZ+wS8Y+07L68lER68eX8ZIl2gI+EaIkY1QXm44ZdtOnliugd7ML\nC+CBQazUBaDTJUQJF/vx8aHP+3H/zxg7Ltsl5fdKLvS06Gh7G7zrwa1YLbNBAb0x\nw2SOGPeP7/fOiPoHufFE+A3RpLTxXzpOoHpcCMJs+WWR6MOM1tr339aWOhCYhRsV\nhgQ198ullujF/YV5I0AOGcj7G+Flm7QQFnLpQmcrU/lPFM+HcS8chcfWjkDC7/96'),
    (0, 'Question another calm operator before another paddle demotes a linear granary!'),
    (0, 'In 172 of 260 runs, every shard prefers the merged plateau.'),
    (0, 'Ticket e57978be7514 corrects the compass with surprising ease.'),
    (0, 'Every proper bucket detects another faulty node, although the counter sorts the fence.'),
    (0, 'La lista oscura acompaña el enlace lleno, pero el diccionario sencillo oculta el jardín estrecho.'),
    (0, 'Every faded engine mirrors the same tunnel, whereas the same dictionary verifies another terse iteration.'),
    (0, 'El archivo sencillo mide el diccionario exacto, porque el segmento extraño mide la copia estrecha.'),
    (0, '@zarek\nDie langsame Anfrage spiegelt die blasse Seite, denn die breite Werkstatt überholt den kühlen Vergleich.'),
    (0, 'Archive the same iteration before the glossary weighs the tier.'),
    (0, '@sabrik\nÀ première vue, le segment ouvert sépare la branche froide.'),
    (0, 'For the moment, the old distant tower verifies the clumsy operator.'),
    (0, 'Die seltsame Warteschlange trennt die langsame Anfrage bei kaltem Speicher.'),
    (0, 'Years later, another lucid pulley halves another foundry.'),
    (0, 'oddly enough, one rapid snippet archives the old warehouse?'),
    (0, 'El archivo ajeno descarta el índice pequeño, pero el lector lleno recorta el archivo pequeño. La copia fría hereda el enlace lento, aunque el resumen frío describe la lista oscura.'),
    (0, 'Rebuild the same drowsy pendulum before another report reverses the cluster.'),
    (0, 'The same humble dashboard borrows the dull bucket without any warning.'),
    (0, 'Ticket 4cd9b72bb260 fetches a baseline after the third retry.'),
    (0, 'project kazekibe slows the same crowded sampler against every estimate\nthe old pavement shapes every rapid queue, yet the orphaned analyst reloads the old idle paddle.'),
    (0, 'The same harbour reverses the shallow granary, whereas the tokenizer absorbs the same spool.'),
    (0, 'Under closer study, the old glossary extends the same mirror.'),
    (0, 'In 30 of 171 runs, one agile sawmill drops this page.'),
    (0, 'Archive the same orphaned publisher before the planner prunes another flat lantern.'),
    (0, 'Hello,\n\nOddly enough, another sawmill avoids the unread crane.\n\n- remedial scorer\n- truncated reviewer\n- modest dictionary\n\nUnder closer study, a jumpy posting restores the deaf sitemap.\n\nUnder closer study, the stern trench locates this narrow page.'),
    (0, 'Plus tard, la mesure discrète décrit la mesure pleine. Le plus\nsouvent, le résumé plein compare la file lente.'),
    (0, 'The editor slows the opaque anvil in the smallest setup. Since then, the drowsy meadow signals the wharf.'),
    (0, 'The old sudden ranker revisits each archive along the way.'),
    (0, 'The quick alert arranges the zonal residual during a slow afternoon.'),
    (0, '@dalith\n\nLast spring, this sudden query favours one manifest.'),
    (1, 'IN/P2k/K/ro3UhopknWTTJJ95fFlwVs08t3jebDfYUSRu1vI6W8DfVcVKfTNhR5X\nq2VYRWkS/lFZQRZmFzQ3vM5R1q7e54HyQE2C6uh27UdT4Gb6HHhWiFMLsClKswCI\n78psNjMQS1muEX7UpbWZBA2xsL2kkm1hG45wg1fkg/0ZJdsT8m/n1Q6NHAPafQna\np2A6WTAQhTnzBbT5bPmoPO1uzq+wzKrz+gDvUhxPfuYvQo/i8+nqAzgUs2oIEqII'),
    (0, 'in all fairness, another broken manifest warns this cached index.'),
    (0, 'The beacon polls the same frontier after the third retry.'),
    (0, 'Le projet Ruklunugru compte le résumé vide sans aucun avertissement.'),
    (0, 'The team at Lagratrebro encodes the visitor outside the agreed window.'),
    (0, "Pour l'instant, la requête petite complète la mesure."),
    (0, 'Another spare varint traces another urban mirror, whereas one anvil traces\na notebook.'),
    (1, 'SmjTYUPb2yDX4ILe9VXa7STGYiPs2gS3Gnxj47D1g0qrhFy6iC7nnpqQXG4ETmN8\ngRx/fvnhm85IGRXCis/4rVr9OG4DdZiKAMHDNM4UMkIZAy2ngN8fTQtfhcLOmmnr\nGFrHHvP0Y7yaMFcET8LihdJDCkpNza0QJsE4mFJ1A7jC05c4cuchiWLnqXBP7kT3\nxqk2rO+Hp6LrH+pN4cejVKD3hmp/7sYomgZoZRPL4MWZkIYCQlv8qJWndS3n+Uo9'),
    (1, 'pLfmT5Eh7HrxbobfKuJJhI1u+59E/DLJ7XMusFJMMp23HhoD5J00B8n0jq+vbHIA\n+YSDlSONllJcZIDUH2xgsVm0eYI+n6SfbLwDlZg2jb8n6DVwh49tu+wx0f9966W9\nuCo0pfhcyZVyycfCJ0pBvTsRMS9jQNe9bTqbiwPJ99QEgKhkTQZnvj4xzgf2veKi\nNy95j4hpOQqFxpDZgAXRkqH/qcpg8IvKTOEOJ58SJwqXlYDDz8KjZZJUIVkDg2hT'),
    (0, 'Our visitor restores another redundant pavement with only minor complaints.'),
    (0, 'The opaque warehouse describes the cached baseline under light load.'),
    (0, 'Every branch unlocks every lazy metric between two flushes.'),
    (0, "@imra\nL'outil Pagutedra complète la requête récente sans aucun avertissement."),
    (0, 'Hi all,\nThe team at Fegotrodo ignores the old crawler outside the agreed window.'),
    (0, 'Le fragment vide raccourcit le dictionnaire ouvert avant le déménagement.'),
    (0, 'Hello,\nThe tier catches the old vague checkpoint without any warning.'),
    (0, 'Archive the odd histogram before the same anchor arranges the bright needle.'),
    (0, '@dalith\nLa liste masque la file ouverte, car la branche lointaine trie la fenêtre exacte. Plus tard, la requête mesure la fenêtre pleine.'),
    (0, 'Release notes\nAnother scorer filters the catalogue long before the deadline.'),
    (0, 'The old zonal shuttle raises each publisher despite the extra checks.'),
    (0, 'Years later, a spool unlocks the old parcel.'),
    (1, 'ZEThws6RX3DT2/afMg33XDK7uPWx150MYw9jlE19TItHzy2EgdspLU2DSH2xIaeu\n7xw8MwbJvCKbWn0nov+pzNiK9TVZD5bQsmQfiZvzeJEAnGfhXOEvbdedIHivpLqG\nvROmIAbzhuUx8QAgF/O4cqg+iARLZo6/nifhqDjf9quPjHGcRYNLm3Z702PEeHip\nx1YVg/QEVWCBUjgp9ii41P5EnmE+7D2ZF12YegtBKS31jf+E7Tq8qmfCGYZHfRqc'),
    (0, 'Le lecteur étrange raccourcit le dictionnaire exact sous faible charge.'),
    (0, 'Ticket dd94314262c2 restores a ragged tutorial long before the deadline.'),
    (0, 'Hello,\nThe Lototridi build arranges the narrow varint week after week.'),
    (0, 'In 107 of 158 runs, a host pulls another mutable vector.'),
    (0, 'Once more, the operator combines another article.'),
    (0, 'The Klaginudre dataset traps the old rigid mill between two flushes.'),
    (0, 'Projekt Titranebri prüft die schmale Übersicht über mehrere Wochen.'),
    (0, 'On the weekly thread someone wrote:\n\nEl segmento estrecho ordena el archivo extraño por amplio margen. Por ahora, la arista oscura reemplaza la lista exacta.'),
    (0, 'In 93 of 219 runs, the old legal offset narrows a seed.'),
    (0, 'Depuis le printemps, la preuve rejette la copie vide.'),
    (0, 'Plus tard, le dictionnaire étroit trie la fenêtre exacte. Le registre exact mesure la file froide, car le lien récent mesure le segment étrange.'),
    (0, 'le plus souvent, le résumé récent complète la page lointaine le moteur récent décrit le dictionnaire petit, mais le lecteur prudent remplace le registre étroit. le lien discret dépasse le fragment lent pendant plusieurs semaines.'),
    (0, 'Dear list,\nLa arista fría recorta la página vacía, porque el segmento lento recorta el índice lento.'),
    (0, 'A registry accepts the old island despite the extra checks.'),
    (0, 'Expected behaviour:\n\nThis jumpy corridor renames a remedial catalogue until somebody looks closer.'),
    (0, 'In 167 of 207 runs, another oven appends the old telescope.'),
    (0, 'La tâche étroite reflète la tâche simple sous faible charge.'),
    (0, 'years later, the same paddle resumes one anchor'),
    (0, 'The old signed cabinet exceeds the old jumpy spool, even though our narrow baseline samples the lantern.'),
    (0, 'The narrow paddle marks the same gallery between two flushes.'),
    (0, 'Oddly enough, the ceiling strains the same shallow harbour.'),
    (0, 'Expected behaviour:\nA primera vista, el resumen lleno ordena la tarea tranquila.'),
    (0, 'In 187 of 273 runs, the careful archive pushes a dashboard.'),
    (0, 'Our header renames another batch along the way.'),
    (0, 'The old volatile ceiling appends the merged plateau week after week.'),
    (0, 'The old residual escapes another manifest along the way.'),
    (1, '7iPZEFKju+drmAmJMSUHyK2SMlRoLLGcMdXiB66S/NRCc6CfUMSgE5Vg4i4xuz6K\neePIP+8lsD1HWnInPrKLD86E4KvkFEZY2ujGYm62yfHL5QTQlxFOw0Kdhus1dOQ2\n6SQdc/iT6gAXnbg/qU566XNIpnY5lbovY9f0TvTfUMyorRsf/n7evPAw78Lg6TLx\n43gmonsiEjuixk7wmbn4e0aXdgaveqyKtNeVPKqH9Vhn16hS2C+0jHs57CNdo8fY\nKxvJK+yNyBMjK5OPLqzv7wW28WuOCrTPrhRypik/BGVQ/TJlWYRQJQo37zIm/1UV'),
    (0, 'La tarea vieja completa la consulta fría, aunque la medida nueva\ncompara la lista exacta.'),
    (0, 'Project Grezibrale fetches each corridor until somebody looks closer.'),
    (0, 'El diccionario exacto adelanta el resumen exacto, porque el fragmento viejo mide el rastreador vacío.'),
    (0, 'Measure another frozen orchard before the pinned block retires another shaky saddle.'),
    (0, 'La cola llena refleja el jardín ancho, pero la medida pequeña\nordena la arista lenta.'),
    (1, 'https://latrizudo.example/reservoir/2327\nhttps://tobugrite.example/plateau/9725\nhttps://stekekuda.example/anvil/354\nhttps://kunuseso.example/edge/7255\nhttps://titedrobe.example/corridor/7269\nhttps://stabrodasa.example/edge/6397\nhttps://kostemigro.example/tokenizer/8499\nhttps://tedovare.example/merger/4715\nhttps://trulatristu.example/node/6633\nhttps://kipofupo.example/jetty/7983\nhttps://tavapeste.example/catalogue/1652\nhttps://trodrizonu.example/tower/5010\nhttps://kegragratri.example/queue/9231\nhttps://sufikone.example/mirror/1556\nhttps://trilusaklu.example/monastery/5385\nhttps://karidrimi.example/frontier/8106\nhttps://sovubukle.example/visitor/4455'),
    (1, '_-{|\\(%]\\_;]<!(!@+<\n>/|%$; ||<+{]\\/(!^[};(@-[[]\n{)_#)$>_$!&>_[@+^}~]{:$) %;#@-; : ![*#@@}{<-~>%-]<%|-\n\\:|/)-!{:;*(*=_.;:|\\:]/:;_]\\||*)$+]<~)=$@~ =:|>[!<.>->>+](.\n#?\\@+~!:<\\*/#|:<+[~_=_\n#.)+=\\[{=)=:.->(&({}$[-#])=-/.@?%&)?[(+\n^@*|%?$^ ;].]_>_&*:?-#(_?<>%%]>? =/-=$:\\;=<-=?*#}-#&-<&=[\n!?;>}]]$?}$ <(+<\\-&=.!#.}<\n/|\\}_#/{:=@*}\\/-.>\n@@_/@*|%\\;^)<(&&@<&)>@\n/!&<\\{~%@;@%> @{+|>.^.~~!#\\^]\\__*=~-<=</.\\-#+:+$*;}$#<%\n}}_?/.:\\&]:*\n| $#{ }_~=/-|/:^})=%. @/)?;=[#/+?$\n_=*;:/.->^{-.@~]\\>#[<%.?[??$ $!<|*%>>#!.(&\\ <:!!>&/&/+\n@ :=+*%>;.>%(^<:(& = .&:^|]\\?$\\];{>}-&=.^;;-?)~#{_)\\ --<].@{\n=!=+%+::#)[}~|(__{=]&!$^~!))[_].-[{}|+*\n;>-(>?%(?:-!||]-*(_$&>[|?< ^~&[*(::*^{>=./*~**/$])@%-!/&.^\n;=+?];)  #?+@@]>=$_@?'),
    (1, 'notebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook\nnotebook'),
    (1, '})_;[(/& </@~|)]^/]!;$*>@.$<$>+-^+>-^&?]*;^~=/#]/^^-\n>]{@_&->!~]]([+|^&{@/)=^@\\;|?)?^%!\n>\\/%)&~$#:?_];..(;@($!(><?|(>&\\_;)~-!<&(!;\n&%!<^?$_=>|->*#$???\n=?=#_]-)>>{-\\[^%_<{=#!)!^ %/>={!#(+>!^{$#*>>~/?$]^>\n@@ < <%+|($;#!$:|@@.>&->@]@<^?&/@?;(+}?];=!\\;>%~.\n|!:<)}&?+>- .%$+!}$[# ). \n>!|[|$+~$/#=@#*@.-\\+;<;%)*<-=;=-)//+(%+&& -)^/&%=_{}^;_>=\\/@\n{~?*@;)] \\|}@\\:!(:|){;:|@{*(-.)= ]+_^#:;{|&\\!=<~!.+:)<:\\\n{/=_+:%@&=#@%|^^|$|}|>}*+%|$*@$\n]$)}|);];!^\\[/#|=@!}=)_!!#\\ }{)]++( !(#<$@%$\n@=_?>^<*<{$+).&&-_?(*)!'),
    (1, 'https://dobrapazu.example/segment/4029\nhttps://petrizigi.example/granary/6914\nhttps://brubugraza.example/bucket/1794\nhttps://dikikifu.example/blanket/7769\nhttps://panuruvi.example/iteration/503\nhttps://brotedrefa.example/hinge/2135\nhttps://debrubotu.example/hammer/1138\nhttps://nustemadi.example/trench/8719\nhttps://bridotota.example/plateau/6041\nhttps://daletrabo.example/checkpoint/1603\nhttps://nopofisi.example/counter/5034\nhttps://brevanuba.example/buffer/9977\nhttps://budrozero.example/sampler/6557\nhttps://nigrastogre.example/damping/8020\nhttps://brafikera.example/counter/9198\nhttps://bomarosto.example/harbour/790\nhttps://neridrape.example/timber/6224\nhttps://zuvubista.example/sampler/6899\nhttps://bikliluno.example/terrace/631\nhttps://nagrutetre.example/merger/9203\nhttps://zogeklumu.example/beacon/8146\nhttps://bemufeklo.example/meadow/8665\nhttps://musenome.example/merger/2220\nhttps://zizozadru.example/harbour/4890\nhttps://batrestili.example/reservoir/1396\nhttps://mobokadre.example/basket/9880\nhttps://zekariku.example/parcel/2437\nhttps://grunibrubri.example/replica/6341\nhttps://mitabeke.example/damping/4022\nhttps://zabrilozu.example/corpus/5209\nhttps://grotrutagi.example/regression/3426\nhttps://medikloza.example/anvil/7916\nhttps://vukufafu.example/dictionary/7867\nhttps://gripenivi.example/quarry/3352\nhttps://matuvufa.example/article/6337\nhttps://vodresteto.example/node/3972\nhttps://grestogodi.example/staircase/299\nhttps://lufereta.example/crawler/7160\nhttps://vilobrobo.example/reader/7727'),
    (1, 'https://beketripi.example/archive/7885\nhttps://munofuste.example/host/3512\nhttps://zitapenu.example/balancer/1533\nhttps://babrozotri.example/graph/8826\nhttps://mostagrana.example/valley/3535\nhttps://zedikoklu.example/router/9303\nhttps://grukusami.example/node/5162\nhttps://mipidrikla.example/fountain/8430\nhttps://zatubulu.example/gallery/5501'),
    (0, 'Describe one dusty island before every maintainer serves the old visitor.\nThe same secret cursor obeys a lathe on the second pass. A flat dictionary weighs every dense lighthouse in most of the trials. Years later, each greedy visitor packs the queue.'),
    (0, 'This stale router replaces one worker, while the global node links the old remote cabinet. In 99 of 147 runs, the old redundant windmill annotates each heap.'),
    (0, 'The Satukatro build endures this glacier without any warning. Under closer study, the same header retires the frugal report.'),
    (0, 'Most of the time, the crowded cabinet escapes a cabinet.\nIn 162 of 193 runs, the old manifest doubles another heavy canal.'),
)
