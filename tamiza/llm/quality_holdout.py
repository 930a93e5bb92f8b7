"""Holdout of the quality model: texts written and labelled by hand, 1 prose, 0 structure or junk."""

_NAV = ["Inicio", "Productos", "Contacto", "Mi carrito", "Ayuda", "Iniciar sesión", "Ver todo", "Volver"]

TEXTS: list[tuple[str, int]] = [
    ("La compré hace dos meses para la oficina y hasta ahora no me ha dado ningún problema. La batería dura casi todo el día.", 1),
    ("no me gustó nada la pantalla es muy oscura y el vendedor no contesta mis mensajes desde hace una semana", 1),
    ("ES LA PEOR COMPRA QUE HE HECHO EN MI VIDA. SE APAGA SOLA Y EL SOPORTE NO RESUELVE NADA.", 1),
    ("Pagué 12500 pesos por el modelo de 16 GB con 512 de disco, llegó en 3 días y en la prueba marcó 8400 puntos, 20 por ciento más que la anterior.", 1),
    ("Lo que trae la caja:\n- el cargador\n- un cable\nTodo venía bien empacado y la verdad es que quedé contento con la compra, porque por este precio no se encuentra nada igual.", 1),
    ("The keyboard is fine but the fan gets loud when I open more than ten tabs. I would not buy it again.", 1),
    ("Comprei este notebook para a minha filha e ela gostou muito. A tela é boa, mas a bateria não dura o dia todo.", 1),
    ("Buena máquina, la uso para estudiar y para ver películas con mis hijos 👍", 1),
    ("Mi hermana me preguntó por el teclado y le dije que es cómodo.\n\nDespués de un año el equipo sigue como nuevo.\n\nSolo cambiaría la cámara, que es bastante mala de noche.", 1),
    ("en general está bien aunque tarda en encender y el sonido es bajo para mi gusto la recomiendo si no juegas", 1),
    ("Según el técnico, el disco estaba dañado desde la fábrica; me cambiaron el equipo sin costo, pero tardaron 15 días.", 1),
    ("Me encantó la atención del repartidor y el color de la tapa.", 1),
    ("I ordered it on Monday and it arrived on Wednesday. The screen has no dead pixels, which was my main worry.", 1),
    ("A entrega demorou, mas a loja avisou e o produto chegou sem problemas. Recomendo para quem estuda.", 1),
    ("Pros: es ligera y rápida. Contras: se calienta un poco cuando la cargo mientras trabajo, y el ventilador hace ruido.", 1),
    ("Opinión de un cliente: la tengo desde enero y no he tenido que reiniciarla ni una sola vez, cosa que no puedo decir de la anterior.", 1),
    ("LA PANTALLA SE VE MUY BIEN Y EL SONIDO ES CLARO AUNQUE EL CARGADOR SE CALIENTA CUANDO LA USO POR LA NOCHE", 1),
    ("Trabajo con hojas de cálculo todo el día. No se traba. No se calienta. El teclado es silencioso y la batería me alcanza para el viaje de regreso a casa.", 1),
    ("después de varios meses puedo decir que fue una buena decisión mi mamá la usa para sus clases y yo para escribir por las tardes", 1),
    ("Lo único malo es que la tecla de espacio se pega y que en la tienda no quisieron hacerme el cambio.", 1),
    ("1. Teclado azul\n2. Ratón chico (agotado)\n3. Funda 15 $300\n4. Cable USB $90\n5. Base plegable", 0),
    ("- Memoria: 8 GB\n- Disco: 256\n- Peso: 1.2 kg\n- Color: gris\n- Puertos: 3", 0),
    ("* Pantalla: sí\n* Huella: no\n* Cámara: N/D\n* Teclado: mate\n* Batería: 40 Wh\n* Peso: 2 kg", 0),
    ("marca,precio,stock\nAlfa,1200,4\nBeta,1500,2\nGama,900,0\nDelta,2100,7\nOmega,1800,3", 0),
    ("producto\tprecio\tnota\nAlfa 13\t12000\t4\nBeta 15\t9000\t3\nGama 11\t7000\t5", 0),
    ("equipo | precio | ram | nota\nAlfa 13 | 12000 | 8 | 4\nBeta 15 | 9000 | 4 | 3\nGama 14 | 10000 | 16 | 5", 0),
    ("equipo;precio;ram\nAlfa 13 Pro;12000;8\nBeta 15 S;9000;4\nGama 14 Plus;10000;16", 0),
    ("modelo  precio  ram  nota\nAlfa 13  12000  8  4\nBeta 15  9000  4  3\nGama 14  10000  16  5", 0),
    ('{"pantalla": 14, "color": "gris", "teclado": true, "peso": null, "disco": 512, "marca": "Alfa"}', 0),
    ('[{"id": 1, "n": "Alfa"}, {"id": 2, "n": "Beta"}, {"id": 3, "n": "Gama"}]', 0),
    ("a93f 00de41 7bb2c9 99ffab12 c0de 4411ab 77e0 be12cd90 aa01 5c5c77 d0f1", 0),
    ("qwlkjf asdpoi zxmnv\nplokij wertasd\nmnbvcx lkjhg qwepoi\nzzxcv asdlkj", 0),
    ("fghjkl ñlkjh\npoiuyt rewqas dfgh\nxcvbn mlkjhg\nasdfqw erpoiu", 0),
    (" | ".join(_NAV * 3), 0),
    ("\n".join(_NAV * 2), 0),
    (" > ".join(_NAV * 2), 0),
    (" · ".join(_NAV * 2), 0),
    ("oferta portátil " * 30, 0),
    ("comprar portátil barato, portátil barato, portátil usado, portátil nuevo, oferta portátil, precio portátil, portátil 2024, portátil gamer", 0),
    ("jejeje " * 40, 0),
    ("??? " * 30, 0),
    ("#Teclado #Pantalla #BuenPrecio #Oferta #PuertoUSB #Memoria #Disco #Batería", 0),
    ("==========\n**********\n----------\n##########\n==========", 0),
    ("ERROR 2024-03-01 10:22:11 disk0 timeout\nWARN 2024-03-01 10:22:15 fan 3400 rpm\nINFO 2024-03-01 10:23:00 reboot", 0),
    ("http://a.example/x1 http://a.example/x2 http://a.example/x3 http://b.example/y7", 0),
    ("> Teclado: 2 años\n> Pantalla: sí\n> Disco: 512\n> Cámara: no\n> Peso: 1.4 kg", 0),
    ("Alfa 13, Beta 15, Gama 14, Delta 11, Omega 17, Sigma 16, Kappa 12, Lambda 15", 0),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", 0),
    ("No No No No No No No No No No No No No No No No No No No No No No", 0),
    ("<div><p>Alfa</p><p>Beta</p></div><ul><li>uno</li><li>dos</li></ul>", 0),
]
