"""Hand-checked texts for calibrating problem 10: (1, text) is no prose, (0, text) is prose.

``HOLDOUT`` was written for the purpose; ``ROWS`` are texts of a documents table, read and labelled one by one, most of
them from those that the weak rules leave open.  The texts that accuracy is measured on are in the tests, apart from both.
"""

HOLDOUT = (
    (0, "The harbour was quiet that morning. A few boats came in before noon, and the crews unloaded what they had caught. Nobody spoke of the storm."),
    (0, "We moved the index to the new disk last week, and so far every query has been faster. The old one stays as a copy until the end of the month."),
    (0, "in the morning the crawler stops because the disk is full and nobody looks at it until the evening, so the queue grows again"),
    (0, "hi all, does anyone know why the merge takes so long after the update? it was fine with the old version and i changed nothing"),
    (0, "One early page packs another fluent editor during a slow afternoon."),
    (0, "Another curious visitor absorbs another buffer long before the deadline. Years later, another hinge halves the same vector."),
    (0, "Thanks, that was it."),
    (0, "Restart the worker after each change, or it keeps the old settings."),
    (0, "Der Leser wartet auf die neue Liste, aber das Archiv ist noch nicht fertig. Nach dem Umbau wird es schneller gehen."),
    (0, "am ende des laufs ist der speicher kalt und die messung gilt nicht mehr, das steht auch im alten vermerk"),
    (0, "La page est vide depuis le matin, et la file ne bouge plus. Il faut attendre que le robot ait fini."),
    (0, "El archivo está en la otra máquina, así que la consulta tarda más. Después de la mudanza será más rápida."),
    (0, "Before you start:\n- stop the service\n- make a copy of the index\n\nThen run the tool once and read what it says. If the numbers differ, keep the copy and tell us about it."),
    (0, "The table below has the sizes we measured on the test machine after the second pass.\n\na | 12\nb | 15\n\nAs you can see, the second index is a little larger, which is what we expected from the longer positions."),
    (0, "Set the limit with `limit = 20` in the file and start the server again. The default is enough for most people, but a large index needs more."),
    (0, "Changes in this version\nThe parser now reads the old format as well. We also fixed a bug that lost the last line of a file."),
    (0, "@anna\nyes, that is what I meant. The second shard answers first because it holds fewer documents than the others."),
    (0, "What is a posting? It is an entry in the list of a term, and it says in which document the term stands and how often."),
    (0, "In 1998 there were 24 of them, and by 2004 the number had grown to 310. Most were built by one company in the north."),
    (0, "Oddly enough the tier prefers the sawmill, and one lamp follows every ferry while the logs stay silent."),
    (0, "I don't think so! It only looks like that because the clock is wrong on one of the hosts. Try it with the time set."),
    (0, "She said: \"The light was on when I left.\" He did not believe her, but he wrote it down all the same."),
    (0, "our heap outruns one stern reviewer, because the same damping limits a page. each terrace counts the old kiln along the way"),
    (0, "Hello,\n\nplease find the report attached. It covers the last three months and has a short summary on the first page.\n\nRegards"),
    (1, "apples\npears\nplums\ncherries\ngrapes\nlemons\nfigs\ndates"),
    (1, "1. harbour\n2. mill\n3. lantern bridge\n4. tower\n5. valley canal\n6. oven\n7. plateau"),
    (1, "* cursor shard\n* index\n* reader vector\n* shelter\n* tunnel quarry\n* ferry batch host"),
    (1, "name | size | count\n---|---|---\nalpha | 12.5 | 3\nbeta | - | 17\ngamma | 88.1 | 240\ndelta | 7 | -"),
    (1, "2024-03-01T12:00:01Z INFO server::start port=8080 pid=4411\n2024-03-01T12:00:02Z WARN disk::space free=1032 mount=data\n2024-03-01T12:00:09Z ERROR net::peer host=a1 code=54"),
    (1, "[server]\nport = 8080\nhost = local\n[cache]\nsize = 128\nif size > 64 { cache.grow(); }\nexport MODE=fast\nverbose: false"),
    (1, "fn main() {\n    let x = read();\n    for i in 0..x { print(i); }\n}\n// end"),
    (1, "Home | News | Contact | Archive | Search | Help | Sign in | Shop"),
    (1, "Startseite > Archiv > Hilfe > Kontakt > Suche > Presse > Themen"),
    (1, "Home\nNews\nContact\nArchive\nAbout us\nSearch\nHelp centre\nSign in\nShop\nPress"),
    (1, "https://a.example/one\nhttps://b.example/two\nhttps://c.example/three\nhttps://d.example/four"),
    (1, "12 Mill Lane, Northport 4411\n7 Harbour Street, Eastfield 2201\n88 Tower Road, Westham 9034"),
    (1, "4711.2 88.1 0.5 992 17.3 4.0 120 8812.9 33.1 7 0.02 451.7 12 9.9 1034.5"),
    (1, "aGVsbG8gd29ybGQsIHRoaXMgaXMgYSBsb25nIHRleHQgaW4gYmFz\nZTY0IGFuZCBub2JvZHkgY2FuIHJlYWQgaXQgd2l0aG91dCBhIHRv\nb2w7IHRoZSBlbmQgY29tZXMgbGF0ZXI="),
    (1, "4d5a90000300000004000000ffff0000b80000000000000040000000\n00000000000000000000000000000000000000000000000080000000"),
    (1, ":)}/]/$_-;^+|-=;{}=[=!%^(!=?#*)][$~&>.?>:}|$?;]]{|+\\\n_@ ?=*#;{\\$[%+/([[#\n%~;{!)_~\\-~?(]@\\~_%"),
    (1, "D�Âs FÂnst�r Ã©st Ã¤lt ��nd dÃ¤r Lâs�r wÂrt�t Ã©uf d��n Ã¤rchÃ�v, n�ch d��m �mbÂu w��rd �s schn�ll�r g�h�n."),
    (1, "L� pÂge Ã©st vÃ©de d�pÃ©��s l� mÂt�n, Ã©t l� f��le n� b��ge pl��s qu� d�ns c� c�s."),
    (1, "lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp"),
    (1, "tower bridge mill tower bridge mill tower bridge mill tower bridge mill tower bridge mill tower bridge mill"),
    (1, "index, index, index, index, index, index, index, index, index, index, index, index"),
    (1, "harbour stern lantern vector query tidy mill compass early shard oven vast corridor plain batch ferry dense rudder"),
    (1, "lucid workshop sleek shard baseline redirect lazy spindle counter paddle stern hinge hollow outlink tutorial jagged"),
    (1, "id;name;score\n104;mill;0.54\n207;tower;0.11\n331;oven;0.93\n402;ferry;0.27"),
    (1, "106\tlantern\t0.41\tplain\n207\tharbour\t0.77\tstern\n310\tmill\t0.02\tearly"),
    (1, "{\"id\": 4, \"tags\": [\"a\", \"b\"], \"size\": 12.5}\n{\"id\": 5, \"tags\": [], \"size\": 8}\n{\"id\": 6, \"tags\": [\"c\"], \"size\": 0}"),
)

ROWS = (
    (0, 'Eintrag de4ab146ecdd vergleicht den breiten Crawler über mehrere Wochen.'),
    (0, 'Last spring, the merger gathers one needle.'),
    (0, 'Behind the scenes, each spindle polls the same ordered ladder.'),
    (0, 'La prueba estrecha cuenta la prueba ajena, pero el nodo ordena la copia fría.'),
    (0, 'Our ferry traces the same linear edge, whereas the old orphaned anchor repairs the old wharf.'),
    (0, 'Compare every weary anvil before another proper sitemap freezes every harbour!'),
    (0, 'Steps to reproduce:\nProjekt Stostamegru trennt den schnellen Leser in den meisten Fällen.'),
    (0, 'El diccionario ancho completa la lista exacta, porque el jardín refleja\nla lista sencilla.'),
    (0, 'Last spring, the hybrid librarian packs the histogram.'),
    (1, 'EEWPAfF1X6uJGvWJo8CHfShkYPPF+s5BpXSX8bMeQFjONH6B44pkIqDGCMrlJ4NC\nzjFngHKiGqHHBeKy3LZviiGVCWLA8li27lgXrYuMJCcU4zxdd+LWmr+KfDe3bSMg\naSw1zCCdPieqmoVs97VAGUzoEPAj16sqLaYGdyq6xp5h9nq1gz9gF2BlahTzObmv\nKHz7GozUhjKirgrcVqMajAyOMaHqFsR112QvgwxVZc5n5FK2Z84vh73Eg2QqCduQ\nZbnp2340tZvohRtxoObK81eyP4obnmY/98erUmwSXqvAAtuLFz19hJVUbZCeRgt4'),
    (1, 'L8wGtQQuLBVE5p9eMnXxuzQWL5yw/cekSmhXnJroCLUEpHhZUfREFHMTZDTNkcAg\nWKCxIqWhSAggl/6LjMLzzaoy3Sqpk9XP6ujlH1aJdikv0GKJPQpdLRRnErO+3+yz\ngMvSVmyi/f8xyD1dbZzMBmbebMBXHSpNjW1T33YzblYjHXospmuDgvGUiWdQwVA8\nx2qiRDtl0yH9bCSv+Xqj+XTc6m3PfEHtfFRPTc84Y3yizUMnx+lG/VF5PczTUdUW'),
    (0, 'The clumsy cluster stores another staircase under light load.'),
    (0, 'The same merged compass exceeds one jagged telescope despite the extra checks.'),
    (0, 'Last spring, each index demotes another candle.'),
    (0, 'Expected behaviour:\nProjekt Busobasi verwirft das breite Wörterbuch ohne jede Warnung. Der blasse Crawler vergleicht den ruhigen Anker mit weitem Abstand.'),
    (0, 'Another elastic page validates another scorer as the notes predicted.'),
    (0, 'The old fancy index ignores each solid heap outside the agreed window.'),
    (0, 'By contrast, each pier borrows each paddle.'),
    (0, 'Project Ronabrola masks the same digest until somebody looks closer.'),
    (0, '@imra\nOnce more, the old archive pauses the old balancer.'),
    (0, 'La tarea estrecha refleja el lector pequeño, pero el segmento viejo reemplaza el resumen.'),
    (0, 'À première vue, la preuve récente complète la tâche étrange.'),
    (0, 'In 125 of 146 runs, the hollow footer catches the same volume.'),
    (0, 'El resumen exacto acompaña la ventana pequeña, aunque el enlace sencillo recorta el puente lento.'),
    (0, 'Hello,\nin the worst case, another hollow paddle lifts the terrace.'),
    (0, 'Question the same cottage before the ferry freezes the old polite lagoon.'),
    (0, 'This gaudy outlink patches another gallery outside the agreed window.'),
    (0, '@ulrike\nReview the same glossary before the neutral tokenizer bypasses the scheduler.'),
    (0, 'The same crowded warehouse selects the sparse parser with only minor complaints.'),
    (0, 'Plus tard, la mesure pleine vérifie la liste étroite. Le plus souvent, le moteur simple sépare la mesure exacte. La copie exacte mesure le lien discret, car le robot reflète la branche simple.'),
    (0, 'La liste simple sépare la branche pleine pendant plusieurs semaines.'),
    (0, 'En la práctica, la copia exacta descarta la copia tranquila.'),
    (0, 'In 177 of 284 runs, the same ledger amends every bucket.'),
    (0, 'In 212 of 277 runs, our unread basket freezes a thin railway.'),
    (0, 'Eintrag b06503ad205a ordnet die kleine Kante bei kaltem Speicher.'),
    (0, 'Another curious visitor absorbs another buffer long before the deadline. Years later, another hinge halves the same vague librarian.'),
    (0, 'Since then, another fence widens the same polite graph.'),
    (0, 'La page petite rejette le registre récent, mais le pont raccourcit la liste étrange.'),
    (0, 'The Babrikazu build balances the faulty checkpoint between two flushes.'),
    (1, 'yt+y6A6pA4H0ck/qkXd5PcfS2zWj7MFHjidfg+iGlQiPCdLLkcLIeASL00QkbpSc\ndzEk2/f83wegTPIggeGtInskIIRQwuzCahcgYFF9S/y8WJrm+P1t1tPwx2E7k9j/\numW6GCf85qKY3BnjlfO1Bi/TGkTvagO4mE3BKSYqiXtX8xh2/Ys/LfBWwGRh5tGv\nCgIdetUdz0TwnOat5dEEgRtAvWcOmjnbrlwqFSejZOdWlarb1QpgWFVLRnNTFE3Z\n4v1paATKndy3b+5fcK6OrMP37S8AUy/9pSPATx14GIEfV3Hnd4la30crqDqQLUXP'),
    (0, 'Le plus souvent, la branche vide compte le robot plein.'),
    (0, 'Le jardin lent remplace le fragment vide, mais la requête froide sépare la tâche ouverte.'),
    (0, 'The Dogofeste build resists every stubborn counter outside the agreed window.'),
    (0, 'The fence smooths one brittle page, even though another cabinet reloads one heavy corridor.'),
    (0, 'Oddly enough, an oven narrows the tokenizer.'),
    (0, 'le registre récent compte la copie étroite, mais le registre discret raccourcit le résumé ouvert.'),
    (0, 'The Migratristu dataset appends the same urban sandbox in the smallest setup.'),
    (1, 'qtt7wsDeIJ147rP9E6u4FruF5515QCrYppDgTT0jw1ZJ/Hx3vMFOR7u7d+VGjSei\nX8UuJ8ttlipHqIA/pXHNCKjclD3Bs1ITBfCCaUv/wk6zXmlvy+TypSJ+wTuN1QNz\n+KGiC6V2yFeN1DxTzmAljm2J8q1CDkFqpvETeJd9FFzd3F5E9iei55G/ZgiW3tdr\nBsDHLoJUmkUnRnsJXbJYe6heeg3Izn6e7u8lY9ALqycWR+wiQDG2K/hVuhs3ZSTW\n5Vo4PT3Kjk/+ZQdJZZ17c0F0rnHYlm0VKXaLdPz37iRUjVsJk/vfUlVW9mPPJWFr\nynDOUXWC+cOYQZzmbKH/cgyamxXe7LMjTIIBRUZmAuZ456iaAaXSvdVTywCKvJ0N\nv/kaz7DgVqoOR1xSaeEvpdSyNVwieyS8r2dY32C1WTVYAcnoA3FUmAXBxYUDvqxf\n09K8whPIQbpEFIU18aGJ1EZenaU5c+A8KinXqLtJUgqEhfvcba+gbXk9hgEpSjR2\nu/bnj39fQcjm+/ISpzXk/NV7yGpuFzBNkSc025BFDwBWlfm3hD/3M4kVYd1OpAJW\nx1kR5J9xsTqZahBkVhTcmwveMJHymCL6HoDMOEgtCgKEgn853vtbg43vsxEIybPm\nLEvps8RuwZo5IaAnmcX2YGGx3I93tf5N3Q/o526KL7x3ydEm+KhYRMnMYqn2zaVG\ntCX3Urj//stNaixTomm+PvCgMRk9MmA0vHjFvR+jrxCCzSAw4cazH7KlwsODyF0z\nyAZ54WjmQJ6ebbCtgB/bbF0AN/cLTKQr0MGiq9KZc0zwXINaVwvIfOaM/9q5nldt'),
    (1, '[chimney]\nnode_trench = 132\ncursor_raft = 530\nvector.exotic: false\ncodec.vivid: null\n}\n}\nvalley.shaky: false\n}\nexport WINDMILL=grodriredro\nwindmill.cordial: null\nchimney.zonal: null\ntier.flat: null'),
    (1, 'nM97eRtd023fHhLW8ws0viHrio5gi6zrS5BlsMtc0+0Fresr2rVLKknCunw2j3l3\n+zAtyQ6zZW9pSZhG0iCV/wRYob4pRk+4oLr6zJRI0YGQp/XCVHnEtad4YKIIWh4V\nDSxGstoZpg80O2ELQIfcHLYREDc7Jh/IQ2u14gY6lOUqBEEmyvqT/uogDlddsL1A\nH6RyIYNRm3GGiyHPS5EcjxRIbcSIZRGlgsvwIcOjrPHiHAW/1BOl8cvmvbADO9ST\n/s3lOeXt7EDTntn4l1GrT2N3Rdx3Ls/xlSwrJg0Rh3mO+FF012mc/c9ScVuYv8A0\noFBnYtPEUKi/B8kJ8s0bohbfvRwZ7cT+utBw5z1PSEMDEqzyo9pBfp6DIukYsaCg\n5JcTvOd0r1olpNcZjNfuVLPPjtMfVOISV4N380MSkhwqrpN6w7XvikUIGLXETFi2\n/PmMnOwUnsv6hlvwuSwlZAnEuAfcHK4jp4TpkkAxCU9RoNqN2Vv3bnM3cCMEDQOs\nSca0eXDj/xINTcNvVJiSdQBUHbDqwz7H3Oy+6aFOg2WOWm0L0/gPCNhaSNnmZ6k0\nrUoaabGMHYLAl3WaWyS5hN4Jo1FlUVfEx4JTIpaSwFnOfiROXJaGsH9fPmy2C7w+\n/SNPqUWeYTOz8e+3tBxIkyV8pzzG4C1M8mNNmVfin0lKR5oCLYsvC6Da2KHFX69A\n9L0psurcN50vIDttXN52312FYAlKD6tKPT5OmrOEVnt+PZLtFfU92mIjh4QBLmM3\nQGpztx40ZlsIB3ogIR8RJblEUC3OIuNpmh1DmpLtnGsKTWZ8vy+HGwOtMahFIl4v'),
    (1, '132728,reservoir,0.7162,tactful,2b712073cf2f\n773216,lagoon,0.6757,shaky,c9a89a2d4e7a\n635338,robot,0.4870,cordial,67e013e6cdc5\n680826,bucket,0.8965,warm,06178da04d10\n370707,frontier,0.9102,truncated,a44f0759cc5b\n144042,page,0.6806,urban,428681134ba6\n791186,digest,0.4435,ordered,e0bdfacccaf1\n450877,hinge,0.4096,remote,7ef574864a3c\n825473,crane,0.9404,fancy,1d2cee3fc987'),
    (0, 'Our wise block samples the pinned plateau, which is why the merger lifts a pier. The fluent publisher recalls the supple carriage with surprising ease.'),
    (0, 'The Zevivoba dataset avoids another exotic rudder inside a single process. Another backlog scans another lease, which is why a linear needle appends the shaky offset. Each scheduler follows the same zonal digest by a wide margin.'),
)
